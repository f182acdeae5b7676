"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import staged


def _stars(pairs: DataFrame, keep) -> DataFrame:
    """Point the ``keep`` neighbours of each vertex ``u`` at the least vertex of its neighbourhood."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u").filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _checksum(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every vertex of ``edges`` (a, b): the least vertex of its component.

    Each round halves the depth of the trees; its edges are written to the shared folder, and only
    their count and checksum come to the driver. A vertex whose edges are loops alone is left out.
    """
    pairs = staged(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = _checksum(pairs)
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, "v > u").filter("u <> v").distinct()
        # Edges point from the larger to the smaller vertex again.
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        pairs = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _checksum(pairs)
        if after == before:
            break
        before = after
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(
        pairs.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    )
