"""Run summaries, appended once per run, and per-run record bundles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.quality import deduplicate
from plumbline.session import shared_dir

#: Groups that a table of runs is kept in; a load rewrites only those of its new runs.
GROUPS = 64


def call_models(prompt_calls: DataFrame) -> DataFrame:
    """Distinct models of agent and critic calls per run, sorted and joined by commas.

    Models collapse per run before they are listed; the set is as small as the model catalogue.
    """
    distinct = prompt_calls.select(
        "run_id", F.col("stage").startswith("critic_").alias("critic"), "prompt_model"
    ).distinct()

    def listed(critic):
        return F.array_join(
            F.sort_array(F.collect_set(F.when(F.col("critic") == critic, F.col("prompt_model")))), ","
        )

    return distinct.groupBy("run_id").agg(listed(False).alias("agent_model"), listed(True).alias("critic_model"))


def run_summaries(
    runs: DataFrame,
    run_metrics: DataFrame,
    prompt_calls: DataFrame,
    evidence_verdicts: DataFrame,
    layer2: DataFrame,
    defects: DataFrame,
) -> DataFrame:
    """One row per run. Rates come from the verdict tables, not from what a run reported."""
    reported = run_metrics.where("reported_arm <> 'B' and best_model_id is not null").select(
        "run_id", F.col("best_primary_metric_value").alias("primary_model_metric"), "override_rate"
    )
    accurate = F.when(F.col("layer1_code") == "EVIDENCE_ACCURATE", 1.0).otherwise(0.0)
    sides = (
        reported,
        call_models(prompt_calls),
        evidence_verdicts.groupBy("run_id").agg(F.avg(accurate).alias("layer1_accuracy_rate")),
        layer2.groupBy("run_id").agg(F.avg("layer2_score").alias("mean_layer2_score")),
        defects.groupBy("run_id").agg(F.avg(F.col("recalled").cast("double")).alias("arm_c_recall")),
    )
    summary = runs
    for side in sides:
        summary = summary.join(side, "run_id", "left")
    return summary


def backfill_status(summaries: DataFrame, existing: DataFrame) -> DataFrame:
    """``created`` for runs not stored yet, ``skipped`` for the others."""
    known = existing.select("run_id").distinct().withColumn("_known", F.lit(True))
    return (
        summaries.join(known, "run_id", "left")
        .withColumn("status", F.when(F.col("_known"), "skipped").otherwise("created"))
        .drop("_known")
    )


def run_group(groups: int) -> Column:
    """The group a run is stored in."""
    return F.pmod(F.xxhash64(F.col("run_id").cast("string")), F.lit(groups)).cast("int")


def append_summaries(
    spark: SparkSession, summaries: DataFrame, path: str, fmt: str = "parquet", groups: int = GROUPS
) -> int:
    """Adds the summaries of new runs to a table kept by group of runs; returns how many there were.

    What the groups of the new runs are to hold (their stored rows and the new ones, one row a run, the
    least where a run comes twice) is written aside, then takes the place of these groups and of no other.
    So a load that is cut off can be run again, and runs stored before stay as they are. A NULL run is one
    run; a load without rows makes no table.
    """
    columns = summaries.columns
    grouped = deduplicate(summaries, ["run_id"]).withColumn("run_group", run_group(groups))
    exists = _exists(spark, path)
    if exists:
        stored = spark.read.schema(grouped.schema).format(fmt).load(path).select(F.col("run_id").alias("_known"))
        grouped = grouped.join(stored, F.col("run_id").eqNullSafe(F.col("_known")), "left_anti")
    fresh = shared_dir(spark, "new-runs")
    seen = Observation()
    grouped.observe(seen, F.count("*").alias("rows")).write.parquet(fresh)
    count = int(seen.get["rows"])
    if not count:
        return 0
    new = spark.read.schema(grouped.schema).parquet(fresh)
    whole = new
    if exists:
        touched = new.select("run_group").distinct()
        kept = spark.read.schema(grouped.schema).format(fmt).load(path).join(touched, "run_group", "left_semi")
        staged = shared_dir(spark, "run-groups")
        kept.select(*new.columns).unionByName(new).write.parquet(staged)
        whole = spark.read.schema(grouped.schema).parquet(staged)
    (
        whole.select(*columns, "run_group")
        .repartition("run_group")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_group")
        .format(fmt)
        .save(path)
    )
    return count


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).isEmpty()
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise
    return True


def bundle_records(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Every record of every run as JSON: (run_id, artifact, record_key, record).

    A run's bundle is its rows in key order. Records stay rows, so a large run is never one value.
    """
    parts = None
    for artifact, (frame, order) in tables.items():
        names = sorted(c for c in frame.columns if not c.startswith("_"))
        part = frame.select(
            "run_id",
            F.lit(artifact).alias("artifact"),
            F.concat_ws("|", *[F.col(c).cast("string") for c in order if c != "run_id"]).alias("record_key"),
            F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("record"),
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


def write_bundles(records: DataFrame, path: str) -> None:
    """JSON lines in a folder per run and artifact, in key order across and within files.

    Rows are range-partitioned by run, artifact and key: a large run spreads over many files.
    """
    (
        records.repartitionByRange("run_id", "artifact", "record_key")
        .sortWithinPartitions("run_id", "artifact", "record_key")
        .select("run_id", "artifact", F.col("record").alias("value"))
        .write.mode("overwrite")
        .partitionBy("run_id", "artifact")
        .text(path)
    )


def append_rows(frame: DataFrame, path: str) -> None:
    """Verdict rows as JSON lines with sorted keys, added to what a table holds.

    Metrics are recomputed from the whole table (``plans.audit``), never patched in place.
    """
    names = sorted(frame.columns)
    frame.select(F.to_json(F.struct(*names)).alias("value")).write.mode("append").text(path)
