"""Planted defects: a constant column, a target leak and a mostly missing column."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import normal
from plumbline.functions.stats import pearson
from plumbline.operators.features import label_codes, with_codes
from plumbline.operators.sampling import smallest_by_hash

# Names and sizes of the planted defects.
CONSTANT = "SYNTH_CONSTANT"
LEAKED = "SYNTH_LEAKED"
HIGH_MISSING = "SYNTH_HIGH_MISSING"
COLUMNS = (CONSTANT, LEAKED, HIGH_MISSING)
LEAK_CORRELATION = 0.99
FLIP_SHARE = 0.005
MISSING_SHARE = 0.6


def check_source(df: DataFrame, target: str) -> None:
    """The target is present and complete and the reserved names are free."""
    if target not in df.columns:
        raise KeyError(f"target column {target!r} is not present")
    taken = [c for c in COLUMNS if c in df.columns]
    if taken:
        raise ValueError(f"reserved columns already present: {taken}")
    if not df.where(F.col(target).isNull()).isEmpty():
        raise ValueError("a leak needs a complete target")


def source_problems(df: DataFrame, target: str) -> DataFrame:
    """The guards as rows (rule, failing): what keeps defects from being planted, 0 where nothing does.

    ``target_present`` and ``names_free`` count columns, ``target_complete`` rows without target. ``target_varies``
    is 1 for a number that never changes, missing ones aside; text needs two labels, not a variance. Without target
    the rules about its values fail for every row and once. An empty table varies in nothing.
    """
    taken = sum(c in df.columns for c in COLUMNS)
    if target in df.columns:
        value = F.col(f"`{target}`")
        gaps = F.count_if(value.isNull())
        same = F.coalesce(F.min(value) == F.max(value), F.lit(True)).cast("bigint")
        present = 0
    else:
        gaps, same, present = F.count("*"), F.lit(1).cast("bigint"), 1
    counted = df.agg(gaps.alias("gaps"), same.alias("same"))
    rules = {
        "target_present": F.lit(present),
        "names_free": F.lit(taken),
        "target_complete": F.col("gaps"),
        "target_varies": F.col("same"),
    }
    rows = [F.struct(F.lit(rule).alias("rule"), failing.cast("bigint").alias("failing")) for rule, failing in rules.items()]
    return counted.select(F.inline(F.array(*rows)))


def leak_numeric(df: DataFrame, target: str, key: str) -> DataFrame:
    """Adds the target plus noise with a sample correlation of exactly LEAK_CORRELATION.

    The noise is made orthogonal to the target; its moments come from one aggregation (one row), so
    the data is read twice and never shuffled.
    """
    y = F.col(target).cast("double")
    noisy = df.withColumn("_z", normal(F.col(key), "leak"))
    m = noisy.agg(
        F.avg(y).alias("y"),
        F.avg("_z").alias("z"),
        F.var_pop(y).alias("vy"),
        F.var_pop("_z").alias("vz"),
        F.covar_pop(y, F.col("_z")).alias("cov"),
    ).first()
    if not m["vy"]:
        raise ValueError("a numeric leak needs target variance")
    slope = m["cov"] / m["vy"]
    residual = math.sqrt(m["vz"] - m["cov"] * m["cov"] / m["vy"])
    width = math.sqrt(m["vy"]) * math.sqrt(1.0 / LEAK_CORRELATION**2 - 1.0) / residual
    noise = (F.col("_z") - m["z"]) - (y - m["y"]) * slope
    return noisy.withColumn(LEAKED, y + noise * width).drop("_z")


def leak_label(df: DataFrame, target: str, key: str) -> DataFrame:
    """Adds the label with 0.5 % of the rows (at least one) moved to the next class."""
    rows = df.count()
    label = F.col(target).cast("string")
    codes = label_codes(df.select(label.alias("label")), "label")
    classes = codes.count()
    if classes < 2:
        raise ValueError("a label leak needs two classes")
    # A table (label, code), where the code is the next class.
    before = codes.select("label", F.pmod(F.col("code") + 1, F.lit(classes)).alias("place"))
    following = before.join(codes.select(F.col("label").alias("next"), F.col("code").alias("place")), "place")
    flipped = smallest_by_hash(df, key, max(1, round(rows * FLIP_SHARE)), "flip")
    moved = with_codes(df, label, following.select("label", F.col("next").alias("code")), "_next")
    return moved.withColumn(LEAKED, F.when(flipped, F.col("_next")).otherwise(label)).drop("_next")


def plant_missing(df: DataFrame, key: str) -> DataFrame:
    """Adds a normal column in which exactly 60 % of the rows are NULL."""
    gone = smallest_by_hash(df, key, round(df.count() * MISSING_SHARE), "missing")
    return df.withColumn(HIGH_MISSING, F.when(~gone, normal(F.col(key), "high_missing")))


def plant_defects(df: DataFrame, target: str, key: str) -> DataFrame:
    """The source with the three defect columns added."""
    check_source(df, target)
    numeric = df.schema[target].dataType.typeName() not in ("string", "boolean")
    leaked = leak_numeric(df, target, key) if numeric else leak_label(df, target, key)
    return plant_missing(leaked.withColumn(CONSTANT, F.lit(1)), key)


def corruption_report(df: DataFrame, target: str) -> DataFrame:
    """The planted defects as measured: distinct values, correlation and missing share."""
    if df.schema[target].dataType.typeName() in ("string", "boolean"):
        codes = label_codes(df.select(F.col(target).cast("string").alias("label")), "label")
        df = with_codes(df, F.col(target), codes, "_y")
        df = with_codes(df, F.col(LEAKED), codes, "_leaked")
        y, leaked = F.col("_y").cast("double"), F.col("_leaked").cast("double")
    else:
        y, leaked = F.col(target).cast("double"), F.col(LEAKED)
    return df.agg(
        F.count_distinct(CONSTANT).alias("constant_nunique"),
        pearson(leaked, y).alias("leaked_corr_with_target"),
        (F.avg(F.col(HIGH_MISSING).isNull().cast("double")) * 100.0).alias("high_missing_pct"),
    )


def replace_sentinel(df: DataFrame, column: str, sentinel: float) -> tuple[DataFrame, DataFrame]:
    """Sentinel to NULL with an indicator column, and the audit row of the correction."""
    indicator = f"{column}_ANOM"
    if column not in df.columns:
        raise KeyError(f"source is missing {column}")
    if indicator in df.columns:
        raise ValueError(f"source already contains {indicator}")
    hit = F.coalesce(F.col(column) == sentinel, F.lit(False))
    fixed = df.withColumn(indicator, hit).withColumn(column, F.when(~hit, F.col(column)))
    audit = df.agg(
        F.lit(column).alias("column_name"),
        F.lit(float(sentinel)).alias("sentinel_value"),
        F.count_if(hit).alias("rows_corrected"),
        F.avg(column).alias("raw_mean"),
        F.avg(F.when(~hit, F.col(column))).alias("cleaned_mean"),
        F.lit(indicator).alias("indicator_column"),
    )
    return fixed, audit


def defect_matches(evidence: DataFrame, claims: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """(run, defect, claim) for critical findings that cite the expected key of a planted defect."""
    defects = F.create_map(*[F.lit(x) for defect, key in expected.items() for x in (key, defect)])
    cited = (
        evidence.where(F.col("metric_key").isin(*expected.values()))
        .select("run_id", "claim_id", defects[F.col("metric_key")].alias("defect"))
        .distinct()
    )
    critical = claims.where("severity = 'critical'").select("run_id", "claim_id")
    return cited.join(critical, ["run_id", "claim_id"]).select("run_id", "defect", "claim_id")


def defect_recall(matches: DataFrame, runs: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """Whether each planted defect of each run was found, and by how many claims."""
    hits = matches.groupBy("run_id", "defect").agg(F.count("*").alias("matching_claims"))
    planted = F.array(
        *[F.struct(F.lit(d).alias("defect"), F.lit(k).alias("expected_metric_key")) for d, k in expected.items()]
    )
    return (
        runs.select("run_id", F.inline(planted))
        .join(hits, ["run_id", "defect"], "left")
        .fillna(0, ["matching_claims"])
        .withColumn("recalled", F.col("matching_claims") > 0)
    )
