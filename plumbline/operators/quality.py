"""Grain de-duplication and data-quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import count_where
from plumbline.operators.joins import any_null

QUALITY_COLUMNS = ("run_id", "rule", "severity", "artifact", "record_key", "message", "details_json")


def deduplicate(df: DataFrame, grain: Sequence[str]) -> DataFrame:
    """One row per grain: the smallest by the remaining columns, so the winner is always the same.

    ``min`` of a struct is combined before the shuffle; no task sees all copies of a hot key.
    """
    rest = [c for c in df.columns if c not in grain]
    if not rest:
        return df.distinct()
    kept = df.groupBy(*grain).agg(F.min(F.struct(*rest)).alias("_row"))
    return kept.select(*[F.col(c) if c in grain else F.col("_row")[c].alias(c) for c in df.columns])


def grain_summary(df: DataFrame, grain: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, duplicated keys and rows with a NULL key, from one aggregation."""
    groups = df.groupBy(*grain).agg(F.count("*").alias("_n"))
    null_key = any_null(grain)
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("bronze_rows"),
        F.count("*").alias("distinct_keys"),
        count_where(F.col("_n") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(null_key, F.col("_n"))), F.lit(0)).alias("null_keys"),
    )


def grain_checks(summary: DataFrame, table_name: str, grain: Sequence[str], silver_rows: Column) -> DataFrame:
    """The four check rows of one table from its summary and the rows written."""
    keys = ", ".join(grain)

    def status(ok: Column) -> Column:
        return F.when(ok, "PASS").otherwise("FAIL")

    zero = F.lit(0).cast("bigint")
    rows = [
        ("row_count", F.lit("INFO"), silver_rows, F.col("bronze_rows"), "Silver rows after grain deduplication"),
        ("null_keys", status(F.col("null_keys") == 0), F.col("null_keys"), zero, keys),
        ("duplicate_keys", status(F.col("duplicate_keys") == 0), F.col("duplicate_keys"), zero, keys),
        (
            "deduplicated_row_count",
            status(silver_rows == F.col("distinct_keys")),
            silver_rows,
            F.col("distinct_keys"),
            "One row per declared table grain",
        ),
    ]
    structs = [
        F.struct(
            F.lit(table_name).alias("table_name"),
            F.lit(kind).alias("check_type"),
            state.alias("status"),
            observed.cast("bigint").alias("observed"),
            expected.cast("bigint").alias("expected"),
            F.lit(details).alias("details"),
        )
        for kind, state, observed, expected, details in rows
    ]
    return summary.select(F.inline(F.array(*structs)))


def join_coverage(enriched: DataFrame) -> DataFrame:
    """Coverage of claims by evidence codes and scores, in one aggregation."""
    code, score = F.col("claim_layer1_code"), F.col("layer2_score")
    accurate = code == "EVIDENCE_ACCURATE"
    return enriched.agg(
        F.count("*").alias("claim_count"),
        F.count(code).alias("layer1_joined"),
        F.count(score).alias("layer2_joined"),
        count_where(accurate & score.isNull()).alias("eligible_missing_layer2"),
        count_where(~accurate & score.isNotNull()).alias("ineligible_with_layer2"),
        count_where(code.isNull()).alias("claims_without_code"),
    )


def missing_artifacts(runs: DataFrame, required: DataFrame, present: DataFrame) -> DataFrame:
    """Required artifacts of each run's arm that are absent."""
    wanted = runs.select("run_id", "arm").join(F.broadcast(required), "arm").select("run_id", "artifact")
    return wanted.join(present.select("run_id", "artifact").distinct(), ["run_id", "artifact"], "left_anti")


def row_count_check(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Manifest row counts against the counts of the written tables."""
    joined = manifest.join(actual, "table_name", "left")
    ok = F.coalesce(F.col("manifest_row_count") == F.col("actual_row_count"), F.lit(False))
    return joined.withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


def quality_rows(
    frame: DataFrame, rule: str, artifact: Column, message: Column, record_key: Column | None = None,
    severity: str = "error", details: Column | None = None,
) -> DataFrame:
    """Rows of the data-quality table from a frame that carries ``run_id``."""
    return frame.select(
        "run_id",
        F.lit(rule).alias("rule"),
        F.lit(severity).alias("severity"),
        artifact.alias("artifact"),
        (F.lit(None) if record_key is None else record_key).cast("string").alias("record_key"),
        message.alias("message"),
        (F.lit("{}") if details is None else details).alias("details_json"),
    )


def frame_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that differ between two computations of one table, with multiplicities.

    One union and one aggregation instead of two ``exceptAll``; grouping treats NULL as a value.
    """
    columns = left.columns
    both = left.select(*columns, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*columns, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    counted = both.groupBy(*columns).agg(F.sum("_l").alias("left_count"), F.sum("_r").alias("right_count"))
    return counted.where("left_count <> right_count")


def planted_frame_problems(original: DataFrame, planted: DataFrame, key: str, target: str, added: int = 3) -> list[str]:
    """Why a planted frame is not the original plus ``added`` columns; empty when it is."""
    new = [c for c in planted.columns if c not in original.columns]
    gone = [c for c in original.columns if c not in planted.columns]
    problems = []
    if gone or len(new) != added:
        problems.append(f"must add exactly {added} columns and remove none; added={new}, removed={gone}")
    if target in gone or key in gone:
        return problems
    changed = frame_differences(original.select(key, target), planted.select(key, target))
    if not changed.isEmpty():
        problems.append("must keep every row and the target")
    return problems
