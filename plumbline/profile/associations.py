"""Associations between columns: target correlation, contingency, pairs, duplicates, VIF."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.stats import count_where, finite, pearson
from plumbline.operators.neighbours import stored
from plumbline.profile.columns import Columns
from plumbline.profile.univariate import EXPRESSION_CHUNK, chunks, means, union_all

PAIR_EXPRESSIONS = 60
DUPLICATE_CORRELATION = 0.999


def category(column: Column, numeric: bool) -> Column:
    """A value as a category label; negative zero is zero."""
    return (column.cast("double") + 0.0).cast("string") if numeric else column.cast("string")


def class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(F.col(f"`{target}`").alias("value")).agg(F.count("*").alias("n"))


def class_balance(counts: DataFrame) -> DataFrame:
    """Share of each class, the NULL class included, rounded to four digits."""
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.join(F.broadcast(total)).select("value", F.round(F.col("n") / F.col("_total"), 4).alias("share"))


def balance_rows(counts: DataFrame, digits: int | None = 4) -> DataFrame:
    """Class balance of any number of classes as rows (sub_key, value); several targets may be told by further columns.

    The missing class is named ``nan``; with ``digits=None`` shares aren't rounded.
    """
    groups = [c for c in counts.columns if c not in ("value", "n")]
    total = counts.groupBy(*groups).agg(F.sum("n").alias("_total"))
    # Stored, so that Spark knows how small the totals are: planned by the size of what they are summed from, they would
    # call all rows of a group into one task.
    joined = counts.join(stored(total, "totals"), groups) if groups else counts.join(F.broadcast(total))
    share = F.col("n") / F.col("_total")
    label = F.coalesce(F.col("value").cast("string"), F.lit("nan"))
    return joined.select(*groups, label.alias("sub_key"), (share if digits is None else F.round(share, digits)).alias("value"))


def is_imbalanced(counts: DataFrame) -> DataFrame:
    """Two classes: minority below 20 %; otherwise any class below 5 %; strict; no class: NULL."""
    present = counts.where("value is not null").agg(
        F.count("*").alias("k"), F.min("n").alias("low"), F.sum("n").alias("total")
    )
    share = F.try_divide(F.col("low").cast("double"), F.col("total").cast("double"))
    flag = F.when(F.col("k") == 0, None).when(F.col("k") == 2, share < 0.20).otherwise(share < 0.05)
    return present.select(flag.alias("is_imbalanced"))


def contingency(df: DataFrame, names: Sequence[str], target: str, columns: Columns) -> DataFrame:
    """(column_name, value, target, n) over rows where both are present."""
    labels = [category(F.col(f"`{c}`"), columns.is_numeric(c)).alias(c) for c in names]
    label = category(F.col(f"`{target}`"), columns.is_numeric(target)).alias("_target")
    long = df.select(label, *labels).unpivot(["_target"], list(names), "column_name", "value")
    return long.dropna().groupBy("column_name", "value", "_target").agg(F.count("*").alias("n"))


def missing_contingency(df: DataFrame, names: Sequence[str], target: str, columns: Columns) -> DataFrame:
    """As ``contingency`` for the missing indicators of the columns."""
    marks = [F.col(f"`{c}`").isNull().cast("string").alias(c) for c in names]
    label = category(F.col(f"`{target}`"), columns.is_numeric(target)).alias("_target")
    long = df.select(label, *marks).unpivot(["_target"], list(names), "column_name", "value")
    return long.dropna().groupBy("column_name", "value", "_target").agg(F.count("*").alias("n"))


def cramers_v(cells: DataFrame) -> DataFrame:
    """Bias-corrected Cramer's V per column from non-empty cells; NULL where it is undefined.

    No join: a value's total goes to its cells, as many as there are classes, by a window, and the cells are then
    summed by class, combined before they are shuffled.
    """
    of_value = Window.partitionBy("column_name", "value")
    n = F.col("n").cast("double")
    by_class = (
        cells.withColumn("_r", F.sum(n).over(of_value))
        .withColumn("_first", (F.row_number().over(of_value.orderBy("_target")) == 1).cast("int"))
        .groupBy("column_name", "_target")
        .agg(F.sum(n * n / F.col("_r")).alias("_part"), F.sum(n).alias("_c"), F.sum("_first").alias("_values"))
    )
    sums = by_class.groupBy("column_name").agg(
        (F.sum(F.col("_part") / F.col("_c")) - 1.0).alias("phi2"),
        F.sum("_values").cast("double").alias("r"),
        F.count("*").cast("double").alias("c"),
        F.sum("_c").alias("total"),
    )
    r, c, m = F.col("r"), F.col("c"), F.col("total") - 1.0
    phi2 = F.greatest(F.lit(0.0), F.col("phi2") - F.try_divide((c - 1) * (r - 1), m))
    limit = F.least(c - F.try_divide((c - 1) * (c - 1), m) - 1, r - F.try_divide((r - 1) * (r - 1), m) - 1)
    value = F.sqrt(F.try_divide(phi2, F.when(limit > 0, limit)))
    return sums.select("column_name", F.when((r >= 2) & (c >= 2), finite(value)).alias("association"))


def target_pearson(df: DataFrame, names: Sequence[str], target: str, missing: bool = False) -> DataFrame:
    """Pearson of each column (or of its missing indicator) with a numeric target, in one aggregation."""
    y = F.col(f"`{target}`").cast("double")

    def side(name):
        c = F.col(f"`{name}`")
        return c.isNull().cast("double") if missing else c.cast("double")

    parts = []
    for group in chunks(names, EXPRESSION_CHUNK):
        row = df.agg(
            *[
                F.struct(F.lit(c).alias("column_name"), finite(pearson(side(c), y)).alias("association")).alias(f"s{i}")
                for i, c in enumerate(group)
            ]
        )
        parts.append(row.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(group))]))))
    return union_all(parts)


def _pairs_by_blocks(df: DataFrame, names: Sequence[str], centers: dict[str, float]) -> DataFrame:
    """Pairwise-complete sums as matrix products per Arrow batch; k*k sums leave each task."""
    k = len(names)
    shift = np.array([centers.get(c) or 0.0 for c in names])
    left, right = np.triu_indices(k, 1)

    def block_sums(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums = np.zeros((6, k, k))
        for batch in batches:
            values = np.column_stack(
                [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(k)]
            )
            present = ~np.isnan(values)
            z = np.where(present, values - shift, 0.0)
            q, m = z * z, present.astype(float)
            sums += (m.T @ m, z.T @ m, m.T @ z, q.T @ m, m.T @ q, z.T @ z)
        yield pa.RecordBatch.from_arrays(
            [pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))]
            + [pa.array(s[left, right]) for s in sums],
            names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"],
        )

    schema = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    total = (
        numbers.mapInArrow(block_sums, schema)
        .groupBy("i", "j")
        .agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    )
    n = F.col("n")
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n)
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    # A constant side leaves rounding dust instead of an exact zero.
    varies = (vx > 1e-12 * F.col("sxx")) & (vy > 1e-12 * F.col("syy")) & (n >= 2)
    value = F.when(varies, F.try_divide(cov, F.sqrt(vx * vy)))
    clipped = F.when(value > 1.0, 1.0).when(value < -1.0, -1.0).otherwise(value)
    label = F.array(*[F.lit(c) for c in names])
    return total.select(
        F.element_at(label, F.col("i") + 1).alias("left_name"),
        F.element_at(label, F.col("j") + 1).alias("right_name"),
        finite(clipped).alias("correlation"),
    )


def pair_correlations(df: DataFrame, names: Sequence[str], centers: dict[str, float] | None = None) -> DataFrame:
    """Pairwise-complete Pearson for every pair of columns: (left_name, right_name, correlation).

    One pass of matrix products for any number of columns. Values are taken from ``centers`` (a value
    of each column near its mean, found first where not given), so large means lose no digits.
    """
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "left_name string, right_name string, correlation double")
    return _pairs_by_blocks(df, names, means(df, names) if centers is None else centers)


def strongest(pairs: DataFrame) -> DataFrame:
    """Largest absolute correlation of each column with any other."""
    both = pairs.select(F.col("left_name").alias("column_name"), "correlation").unionByName(
        pairs.select(F.col("right_name").alias("column_name"), "correlation")
    )
    return both.groupBy("column_name").agg(F.max(F.abs("correlation")).alias("strongest"))


def missing_indicators(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").isNull().cast("double").alias(c) for c in names])


def fingerprints(df: DataFrame, columns: Columns) -> DataFrame:
    """Order-free content fingerprint per column; equal columns have equal fingerprints."""
    parts = []
    for names in chunks(columns.order, EXPRESSION_CHUNK):
        row = df.agg(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.lit(columns.dtypes[c]).alias("dtype"),
                    F.count(F.col(f"`{c}`")).alias("n"),
                    F.bit_xor(F.xxhash64(F.col(f"`{c}`"))).alias("content"),
                    F.sum(F.xxhash64(F.col(f"`{c}`")) % 1000003).alias("checksum"),
                ).alias(f"f{i}")
                for i, c in enumerate(names)
            ]
        )
        parts.append(row.select(F.inline(F.array(*[F.col(f"f{i}") for i in range(len(names))]))))
    return union_all(parts)


def verify_duplicates(
    df: DataFrame, exact: Sequence[tuple[str, str]], near: Sequence[tuple[str, str]]
) -> DataFrame:
    """Row-by-row check of candidate pairs: identical, or with nearly the same range over the pairs."""
    parts = []
    marked = [(a, b, True) for a, b in exact] + [(a, b, False) for a, b in near]
    for group in chunks(marked, PAIR_EXPRESSIONS):
        row = df.agg(*[_duplicate_test(a, b, e).alias(f"d{i}") for i, (a, b, e) in enumerate(group)])
        parts.append(row.select(F.inline(F.array(*[F.col(f"d{i}") for i in range(len(group))]))))
    if not parts:
        return df.sparkSession.createDataFrame([], "left_name string, right_name string, duplicate boolean")
    return union_all(parts)


def _duplicate_test(a: str, b: str, exact: bool) -> Column:
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    if exact:
        same = count_where(~x.eqNullSafe(y)) == 0
    else:
        infinite = F.lit(float("inf"))
        both = (
            x.isNotNull()
            & y.isNotNull()
            & (F.abs(x.cast("double")) != infinite)
            & (F.abs(y.cast("double")) != infinite)
        )
        xs, ys = F.when(both, x.cast("double")), F.when(both, y.cast("double"))

        def close(u, v):
            return F.abs(u - v) <= 1e-8 + 1e-3 * F.abs(v)

        same = F.coalesce(close(F.min(xs), F.min(ys)) & close(F.max(xs), F.max(ys)), F.lit(False))
    return F.struct(F.lit(a).alias("left_name"), F.lit(b).alias("right_name"), same.alias("duplicate"))


def variance_inflation(correlations: np.ndarray) -> list[float | None]:
    """VIF per column from a correlation matrix; NULL where the others determine the column.

    One eigendecomposition: the diagonal of the inverse, and columns with a part in a direction
    without variance are the collinear ones.
    """
    values, vectors = np.linalg.eigh(correlations)
    squares = vectors**2
    flat = values <= 1e-10
    lost = squares[:, flat].sum(axis=1)
    factors = (squares[:, ~flat] / values[~flat]).sum(axis=1)
    return [None if gone > 1e-8 or f >= 1e10 else float(f) for gone, f in zip(lost, factors)]
