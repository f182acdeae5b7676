"""Ranks and running totals over groups of any size.

A plain window over a hot group is one task. Here a group is first cut into ordered buckets, bucket
totals give each bucket its starting offset, and only rows of one bucket are ordered together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.hashing import keyed_md5
from plumbline.session import shared_dir

HASH_BUCKET_DIGITS = 3


def hash_rank(df: DataFrame, group: Sequence[str], key: str, output: str, salt: str = "") -> DataFrame:
    """Zero-based position of each row within its group, ordered by the hash of a unique key."""
    tagged = df.withColumn("_digest", keyed_md5(F.col(key), salt)).withColumn(
        "_bucket", F.substring("_digest", 1, HASH_BUCKET_DIGITS)
    )
    sizes = tagged.groupBy(*group, "_bucket").agg(F.count("*").alias("_size"))
    # At most 16^3 rows per group.
    by_bucket = Window.partitionBy(*group).orderBy("_bucket")
    offsets = sizes.withColumn("_offset", F.sum("_size").over(by_bucket) - F.col("_size")).drop("_size")
    inside = Window.partitionBy(*group, "_bucket").orderBy("_digest", key)
    return (
        tagged.withColumn("_position", F.row_number().over(inside))
        .join(offsets, [*group, "_bucket"])
        .withColumn(output, F.col("_position") - 1 + F.col("_offset"))
        .drop("_digest", "_bucket", "_position", "_offset")
    )


def running_totals(df: DataFrame, group: Sequence[str], order: str, sums: Sequence[str]) -> DataFrame:
    """Adds ``cum_{c}`` (inclusive running total by ascending ``order``) and ``all_{c}`` per group.

    ``df`` has one row per group and order value. Rows are range-partitioned by group and order, so a
    group takes as many partitions as its rows need; totals of a group in a partition give the others
    their offsets. The ranges are stored, for their partition numbers must not change in between.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "ranges")
    ranged = df.repartitionByRange(*group, order).withColumn("_part", F.spark_partition_id())
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    totals = ranged.groupBy(*group, "_part").agg(*[F.sum(c).alias(f"_b_{c}") for c in sums])
    # One row for each partition that a group has rows in.
    by_part = Window.partitionBy(*group).orderBy("_part")
    offsets = totals.select(
        *[F.col(g).alias(f"_g_{g}") for g in group],
        F.col("_part").alias("_p"),
        *[(F.sum(f"_b_{c}").over(by_part) - F.col(f"_b_{c}")).alias(f"_o_{c}") for c in sums],
        *[F.sum(f"_b_{c}").over(Window.partitionBy(*group)).alias(f"all_{c}") for c in sums],
    )
    inside = Window.partitionBy(*group, "_part").orderBy(order)
    result = ranged.withColumns({f"_w_{c}": F.sum(c).over(inside) for c in sums})
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    result = result.join(offsets, same)
    result = result.withColumns({f"cum_{c}": F.col(f"_w_{c}") + F.col(f"_o_{c}") for c in sums})
    return result.drop("_part", "_p", *[f"_g_{g}" for g in group], *[f"_w_{c}" for c in sums], *[f"_o_{c}" for c in sums])
