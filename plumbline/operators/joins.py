"""Joins: guarded column names, skew-safe lookups, enrichment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1 / 200
SALTS = 32
TRACKED = 10_000


def any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def check_join_columns(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    """Spark would silently return both copies of a shared non-key column; refuse instead."""
    for side, frame in (("left", left), ("right", right)):
        repeated = sorted({c for c in frame.columns if frame.columns.count(c) > 1})
        if repeated:
            raise ValueError(f"{side} side has repeated columns: {repeated}")
        missing = [k for k in keys if k not in frame.columns]
        if missing:
            raise ValueError(f"{side} side lacks join keys: {missing}")
    shared = sorted((set(left.columns) & set(right.columns)) - set(keys))
    if shared:
        raise ValueError(f"join would produce ambiguous columns: {shared}")


def guarded_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    check_join_columns(left, right, keys)
    return left.join(right, list(keys), how)


def _hot_keys(left: DataFrame, keys: Sequence[str]) -> tuple[list[int], bool]:
    """Hashes of the keys that hold more than HOT_SHARE of the rows, and whether NULL keys do.

    One frequent-items sketch over the key columns; at most 1/HOT_SHARE hashes reach the driver.
    """
    no_key = any_null(keys)
    found = left.agg(
        F.count("*").alias("rows"),
        F.count_if(no_key).alias("nulls"),
        F.expr(f"approx_top_k(CASE WHEN NOT ({' OR '.join(f'`{k}` IS NULL' for k in keys)}) "
               f"THEN xxhash64({', '.join(f'`{k}`' for k in keys)}) END, {TRACKED // 40}, {TRACKED})").alias("top"),
    ).first()
    limit = found["rows"] * HOT_SHARE
    return [t["item"] for t in found["top"] if t["item"] is not None and t["count"] > limit], found["nulls"] > limit


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join to a side that is unique by ``keys``, safe when a few keys hold most left rows.

    Keys that hold more than HOT_SHARE of the rows are found first. Their rows, and rows with a NULL
    key (which match nothing), are spread over ``SALTS`` partitions, and their few right rows are
    copied to each of them. Without hot keys this is a plain join.
    """
    keys = list(keys)
    check_join_columns(left, right, keys)
    kinds = dict(left.dtypes)
    right = right.withColumns({k: F.col(k).cast(kinds[k]) for k in keys if dict(right.dtypes)[k] != kinds[k]})
    hot, hot_nulls = _hot_keys(left, keys)
    if not hot and not hot_nulls:
        return left.join(right, keys, "left")
    is_hot = F.xxhash64(*keys).isin(hot) if hot else F.lit(False)
    hashed = [f.name for f in left.schema.fields if "map<" not in f.dataType.simpleString()]
    spread = F.pmod(F.xxhash64(*hashed) + F.spark_partition_id(), F.lit(SALTS))
    zero = F.lit(0).cast("bigint")
    salted = left.withColumn("_salt", F.when(is_hot | any_null(keys), spread).otherwise(zero))
    copies = F.when(is_hot, F.sequence(zero, zero + (SALTS - 1))).otherwise(F.array(zero))
    replicated = right.withColumn("_salt", F.explode(copies))
    return salted.join(replicated, [*keys, "_salt"], "left").drop("_salt")


def enrich_claims(claims: DataFrame, layer1: DataFrame, layer2: DataFrame) -> DataFrame:
    """Claims with their evidence code and critic score; claims without either are kept."""
    keys = ["run_id", "claim_id"]
    return guarded_join(guarded_join(claims, layer1, keys, "left"), layer2, keys, "left")


def orphans(verdicts: DataFrame, claims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Verdict rows whose claim does not exist."""
    return verdicts.join(claims.select(*keys), list(keys), "left_anti")


def layer2_gate(eligible: DataFrame, scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both directions of the score gate in one pass over the two key sets."""
    marks = eligible.select(*keys, F.lit(1).alias("e"), F.lit(0).alias("s")).unionByName(
        scored.select(*keys, F.lit(0).alias("e"), F.lit(1).alias("s"))
    )
    sides = marks.groupBy(*keys).agg(F.max("e").alias("e"), F.max("s").alias("s"))
    rule = F.when(F.col("s") == 0, "layer2_missing_eligible").otherwise("layer2_ineligible_claim")
    return sides.where(F.col("e") != F.col("s")).select(*keys, rule.alias("rule"))
