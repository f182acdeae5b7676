"""Exact-size selection of rows by the hash of a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import keyed_md5

DIGITS_PER_ROUND = 3
SMALL_BUCKET = 4096


def smallest_by_hash(df: DataFrame, key: str, k: int, salt: str) -> Column:
    """A filter that holds for exactly the ``k`` rows with the smallest hash of their key.

    Counts by hash prefix (at most 16^3 per round) close in on the bucket that holds the k-th row;
    only that bucket is ordered. Rows are never moved: the result is a comparison with a literal.
    """
    digest = keyed_md5(F.col(key), salt)
    if k <= 0:
        return F.lit(False)
    prefix, remaining = "", k
    while True:
        inside = df if not prefix else df.where(digest.startswith(prefix))
        width = len(prefix) + DIGITS_PER_ROUND
        rows = inside.groupBy(F.substring(digest, 1, width).alias("p")).agg(F.count("*").alias("n")).collect()
        size = 0
        for row in sorted(rows):
            if row["n"] >= remaining:
                prefix, size = row["p"], row["n"]
                break
            remaining -= row["n"]
        else:
            raise ValueError(f"cannot take {k} rows: the source has fewer")
        if size <= SMALL_BUCKET:
            break
        if width >= 32:
            raise ValueError(f"{key} is not unique: {size} rows share one value")
    bucket = df.where(digest.startswith(prefix)).select(digest.alias("d"), F.col(key).alias("k"))
    last = bucket.orderBy("d", "k").limit(remaining).collect()[-1]
    cut = F.lit(last["d"])
    return (digest < cut) | ((digest == cut) & (F.col(key) <= F.lit(last["k"])))


def sample_exact(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows, the same ones for any partitioning; fails when the source has fewer."""
    return df.where(smallest_by_hash(df, key, k, f"sample{seed}"))
