"""Bronze and silver loads over a table folder.

The format is a parameter (``parquet`` here; any table format Spark has on its class path works).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.joins import enrich_claims
from plumbline.operators.quality import deduplicate, grain_checks, grain_summary, join_coverage
from plumbline.plans import gold
from plumbline.profile.univariate import union_all
from plumbline.sinks.export import write_counted
from plumbline.sources.schemas import GRAINS, TABLES, schema

LINEAGE = ("_ingested_at", "_export_manifest_sha256")


def manifest_digest(spark: SparkSession, export: str) -> str:
    """SHA-256 of the SHA-256 digests of all manifest files, in path order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{export}/manifest")
    listed = F.sort_array(F.collect_list(F.struct("path", F.sha2("content", 256).alias("h"))))
    digest = F.sha2(F.array_join(F.transform(listed, lambda x: x["h"]), ","), 256)
    row = files.agg(F.count(F.lit(1)).alias("n"), digest.alias("digest")).first()
    if not row["n"]:
        raise FileNotFoundError(f"Export manifest not found: {export}/manifest")
    return row["digest"]


def load_bronze(spark: SparkSession, export: str, warehouse: str, fmt: str = "parquet") -> DataFrame:
    """Copies every exported table with lineage columns; fails when a row count is off."""
    digest = manifest_digest(spark, export)
    results = []
    for row in sorted(spark.read.json(f"{export}/manifest").collect(), key=lambda r: r["table_name"]):
        name = row["table_name"]
        bronze = spark.read.schema(schema(name)).parquet(f"{export}/{row['path']}").withColumns(
            {"_ingested_at": F.current_timestamp(), "_export_manifest_sha256": F.lit(digest)}
        )
        actual = write_counted(bronze, f"{warehouse}/bronze_{name}", fmt)
        if actual != row["row_count"]:
            raise RuntimeError(f"Bronze row-count mismatch for {name}: manifest={row['row_count']}, table={actual}")
        results.append((name, row["row_count"], actual, f"{warehouse}/bronze_{name}"))
    return spark.createDataFrame(
        results, "table_name string, manifest_row_count bigint, bronze_row_count bigint, target_table string"
    )


def cast_columns(frame: DataFrame, table: str) -> DataFrame:
    """Declared columns and lineage; a value that does not cast becomes NULL."""
    casted = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema(table).fields]
    return frame.select(*casted, *[c for c in LINEAGE if c in frame.columns])


def cast_failures(frame: DataFrame, table: str) -> DataFrame:
    """Values per column that did not cast: (column_name, failures)."""
    fields = schema(table).fields
    lost = [
        F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f.name)
        for f in fields
    ]
    names = [f.name for f in fields]
    return frame.agg(*lost).unpivot([], names, "column_name", "failures").where("failures > 0")


def load_silver(spark: SparkSession, warehouse: str, fmt: str = "parquet") -> DataFrame:
    """Cast, one row per grain, checks, enriched claims. Returns (and stores) the check rows.

    Each bronze table is read twice: once for its grain summary, once for the write, whose row
    count is observed rather than counted again.
    """
    checks = []
    for name in TABLES:
        casted = cast_columns(spark.read.format(fmt).load(f"{warehouse}/bronze_{name}"), name)
        grain = list(GRAINS[name])
        silver_rows = write_counted(deduplicate(casted, grain), f"{warehouse}/silver_{name}", fmt)
        checks.append(grain_checks(grain_summary(casted, grain), name, grain, F.lit(silver_rows)))

    def silver(name):
        return spark.read.format(fmt).load(f"{warehouse}/silver_{name}")

    layer1 = silver("layer1_claim_verdicts").select("run_id", "claim_id", "citation_layer1_codes", "claim_layer1_code")
    layer2 = silver("layer2_verdicts").select(
        "run_id",
        "claim_id",
        "layer2_score",
        F.col("discrepancy_note").alias("layer2_discrepancy_note"),
        F.col("critic_confidence").alias("layer2_critic_confidence"),
    )
    enriched = enrich_claims(silver("claims").drop(*LINEAGE), layer1, layer2)
    enriched.write.mode("overwrite").format(fmt).save(f"{warehouse}/silver_claims_enriched")
    checks.append(coverage_checks(join_coverage(spark.read.format(fmt).load(f"{warehouse}/silver_claims_enriched"))))
    result = union_all(checks).withColumn("checked_at", F.current_timestamp())
    result.write.mode("overwrite").format(fmt).save(f"{warehouse}/silver_data_quality_checks")
    return spark.read.format(fmt).load(f"{warehouse}/silver_data_quality_checks")


def coverage_checks(coverage: DataFrame) -> DataFrame:
    """Join coverage as check rows: counts as information, the gate as pass or fail."""
    def row(kind, column, gate):
        state = F.when(F.col(column) == 0, "PASS").otherwise("FAIL") if gate else F.lit("INFO")
        expected = F.lit(0).cast("bigint") if gate else F.col("claim_count")
        return F.struct(
            F.lit("claims_enriched").alias("table_name"),
            F.lit(kind).alias("check_type"),
            state.alias("status"),
            F.col(column).cast("bigint").alias("observed"),
            expected.alias("expected"),
            F.lit("Claims with evidence codes and scores").alias("details"),
        )

    rows = [
        row("layer1_join_coverage", "layer1_joined", False),
        row("layer2_join_coverage", "layer2_joined", False),
        row("eligible_missing_layer2", "eligible_missing_layer2", True),
        row("ineligible_with_layer2", "ineligible_with_layer2", True),
        row("claims_without_code", "claims_without_code", True),
    ]
    return coverage.select(F.inline(F.array(*rows)))


def load_gold(spark: SparkSession, warehouse: str, base_rate_dataset: str, fmt: str = "parquet") -> dict[str, int]:
    """The gold tables; returns their row counts."""
    def silver(name):
        return spark.read.format(fmt).load(f"{warehouse}/silver_{name}")

    runs, enriched = silver("runs"), silver("claims_enriched")
    per_run = gold.per_run_decision(enriched, runs)
    tables = {
        "layer1_rates": gold.verdict_rates(silver("layer1_evidence_verdicts"), silver("claims"), runs),
        "layer2_scores": gold.layer2_scores(enriched, runs),
        "arm_c_detection": gold.detection(silver("arm_c_defects"), runs),
        "decision_scores": per_run,
        "decision_consistency": gold.decision_consistency(per_run),
        "model_metrics": gold.model_metrics(
            silver("run_metrics"), silver("model_evaluations"), silver("evidence_refs"), runs, base_rate_dataset
        ),
    }
    return {name: write_counted(t, f"{warehouse}/gold_{name}", fmt) for name, t in tables.items()}
