"""Per-column statistics: moments, value frequencies, exact quantiles, outliers."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ranking import running_totals
from plumbline.functions.stats import adjusted_kurtosis, adjusted_skew, count_where, finite, ratio
from plumbline.profile.columns import Columns

EXPRESSION_CHUNK = 40
SKETCH_ACCURACY = 10_000
#: Share of the rows on either side of a rank that its bracket takes in: five times the sketch's error.
MARGIN = 5.0 / SKETCH_ACCURACY


def chunks(names: Sequence, size: int) -> list[Sequence]:
    return [names[i : i + size] for i in range(0, len(names), size)]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def numeric_values(df: DataFrame, columns: Columns) -> DataFrame:
    """(column_name, value) of all numeric columns, NULLs included."""
    names = list(columns.numeric)
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in names]).unpivot(
        [], names, "column_name", "value"
    )


def means(df: DataFrame, names: Sequence[str]) -> dict[str, float | None]:
    """Column means, for centring."""
    row = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(c) for c in names]).first()
    return row.asDict()


def moments(df: DataFrame, columns: Columns) -> DataFrame:
    """One row per column.

    Numeric columns go through one grouped aggregation of the unpivoted values: one aggregate over
    all columns would be a generated method too large for the JIT compiler.
    """
    parts = []
    if columns.numeric:
        v = F.col("value")
        present = F.count(v)
        whole = F.coalesce(F.bool_and(v % 1 == 0), F.lit(False))
        numbers = {
            "mean": F.avg(v),
            "std": F.stddev_samp(v),
            "min": F.min(v),
            "max": F.max(v),
            "skew": adjusted_skew(v),
            "kurtosis": adjusted_kurtosis(v),
        }
        parts.append(
            numeric_values(df, columns)
            .groupBy("column_name")
            .agg(
                F.count("*").alias("n_rows"),
                present.alias("n"),
                *[finite(value).alias(label) for label, value in numbers.items()],
                whole.alias("is_whole"),
            )
        )
    rest = [c for c in columns.order if not columns.is_numeric(c)]
    empty = [F.lit(None).cast("double").alias(c) for c in ("mean", "std", "min", "max", "skew", "kurtosis")]
    for names in chunks(rest, EXPRESSION_CHUNK):
        row = df.agg(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.count("*").alias("n_rows"),
                    F.count(F.col(f"`{c}`")).alias("n"),
                    *empty,
                    F.lit(False).alias("is_whole"),
                ).alias(f"s{i}")
                for i, c in enumerate(names)
            ]
        )
        parts.append(row.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(names))]))))
    return union_all(parts)


def _frequencies(df: DataFrame, names: Sequence[str], sql_type: str) -> DataFrame:
    typed = df.select(*[F.col(f"`{c}`").cast(sql_type).alias(c) for c in names])
    long = typed.unpivot([], list(names), "column_name", "value")
    return long.where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n"))


def value_frequencies(df: DataFrame, columns: Columns) -> dict[str, DataFrame]:
    """(column_name, value, n) per value type, each from one shuffle of map-side combined counts."""
    groups = {
        "bigint": columns.integral,
        "double": columns.fractional,
        "string": (*columns.categorical, *columns.other),
    }
    return {kind: _frequencies(df, names, kind) for kind, names in groups.items() if names}


def frequency_summary(frequencies: dict[str, DataFrame]) -> DataFrame:
    """Distinct values, present values and the count of the most frequent value per column."""
    return union_all(
        [
            f.groupBy("column_name").agg(
                F.count("*").alias("nunique"), F.sum("n").alias("n"), F.max("n").alias("top_n")
            )
            for f in frequencies.values()
        ]
    )


def _disjoint(brackets: list[list[float]], count: int) -> list[list[float | None]]:
    """Brackets in order, those that meet as one; NaN is the greatest, as in Spark. Filled up to ``count``."""
    key = lambda x: (x != x, x)
    out: list[list[float | None]] = []
    for lo, hi in sorted(brackets, key=lambda b: key(b[0])):
        if out and key(lo) <= key(out[-1][1]):
            out[-1][1] = max(out[-1][1], hi, key=key)
        else:
            out.append([lo, hi])
    return out + [[None, None]] * (count - len(out))


def exact_quantiles(values: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Interpolated quantiles per column: (column_name, prob, quantile), exact, by two scans of any distribution.

    An approximate quantile is off by at most 1/SKETCH_ACCURACY of the rows, so the estimates a little
    below and above a rank bracket it. The second scan counts what lies below each bracket and the
    values inside it, a thousandth of the rows or so; running totals of those find the rank. No rows
    are gathered: what reaches the driver is one bracket and two values for each column and quantile.
    """
    spark = values.sparkSession
    present = values.where("value is not null")
    ends = [min(1.0, max(0.0, p + d)) for p in probs for d in (-MARGIN, MARGIN)]
    cuts = present.groupBy("column_name").agg(
        F.percentile_approx("value", F.array(*[F.lit(e) for e in ends]), F.lit(SKETCH_ACCURACY)).alias("cuts"),
        F.count("*").alias("total"),
        F.min("value").alias("low"),
        F.max("value").alias("top"),
    )
    wanted, bounds, parts = [], [], {}
    for row in cuts.collect():
        name, total = row["column_name"], row["total"]
        apart: list[list[float]] = []
        for i, p in enumerate(probs):
            position = p * (total - 1)
            # The margin must be worth some rows; of few rows all are inside.
            lo, hi = (row["cuts"][2 * i], row["cuts"][2 * i + 1]) if total * MARGIN >= 2 else (row["low"], row["top"])
            apart.append([lo, hi])
            wanted.append((name, i, math.floor(position), math.ceil(position)))
            parts[name, i] = (position - math.floor(position), float(p))
        bounds.append((name, *[e for bracket in _disjoint(apart, len(probs)) for e in bracket]))
    ends_ = [f"{side}{i}" for i in range(len(probs)) for side in ("lo", "hi")]
    schema = "column_name string, " + ", ".join(f"{e} double" for e in ends_)
    v = F.col("value")
    # Even numbers are the gaps before, between and after the brackets, odd ones the brackets.
    steps = [F.when(v >= F.col(e) if e[0] == "l" else v > F.col(e), 1).otherwise(0) for e in ends_]
    bracketed = present.join(F.broadcast(spark.createDataFrame(bounds, schema)), "column_name").select(
        "column_name", "value", reduce(lambda a, b: a + b, steps).alias("segment")
    )
    place = F.struct("segment", F.when(F.col("segment") % 2 == 1, v).alias("value"))
    counted = bracketed.groupBy("column_name", place.alias("place")).agg(F.count("*").alias("n"))
    ranked = F.broadcast(spark.createDataFrame(wanted, "column_name string, i int, first bigint, second bigint"))
    placed = running_totals(counted, ["column_name"], "place", ["n"]).join(ranked, "column_name")
    picked = placed.groupBy("column_name", "i").agg(
        F.min(F.when(F.col("cum_n") > F.col("first"), F.col("place"))).getField("value").alias("low"),
        F.min(F.when(F.col("cum_n") > F.col("second"), F.col("place"))).getField("value").alias("high"),
    )
    rows = []
    for row in picked.collect():
        part, prob = parts[row["column_name"], row["i"]]
        low, high = row["low"], row["high"]
        rows.append((row["column_name"], prob, low if low == high or low != low else low * (1.0 - part) + high * part))
    return spark.createDataFrame(rows, "column_name string, prob double, quantile double")


def quartiles(values: DataFrame) -> DataFrame:
    q = exact_quantiles(values, (0.25, 0.5, 0.75))
    return q.groupBy("column_name").agg(
        *[
            F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(label)
            for p, label in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
        ]
    )


def spread(values: DataFrame) -> DataFrame:
    """Quartiles, share of zeros and counts outside the whiskers, from the values and their quartiles."""
    low = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    high = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    outside = (F.col("value") < low) | (F.col("value") > high)
    return (
        values.where("value is not null")
        .join(F.broadcast(quartiles(values)), "column_name")
        .groupBy("column_name", "q1", "median", "q3")
        .agg(F.count("*").alias("n"), F.count_if(F.col("value") == 0).alias("zeros"), F.count_if(outside).alias("outliers"))
    )


def outlier_profile(spread_rows: DataFrame) -> DataFrame:
    """Outlier share, zero inflation and nonzero share from ``spread``."""
    zero_share = ratio(F.col("zeros"), F.col("n"))
    inflated = (F.col("q1") == F.col("q3")) & (zero_share > 0.5)
    pct = F.round(ratio(F.col("outliers"), F.col("n")) * 100.0, 2)
    return spread_rows.select(
        "column_name",
        "q1",
        "median",
        "q3",
        F.when(inflated, None).when(F.col("q1") == F.col("q3"), 0.0).otherwise(pct).alias("iqr_outlier_pct"),
        inflated.alias("is_zero_inflated"),
        F.round((1.0 - zero_share) * 100.0, 2).alias("nonzero_pct"),
    )


def sequential(frequencies: dict[str, DataFrame]) -> DataFrame:
    """Columns of three or more whole values with one constant step, without sorting them.

    With the step fixed by range and count, all distinct values lie on the lattice exactly when
    every gap is that step. Integers stay integers; a range beyond 64 bits counts as not sequential.
    """
    parts = []
    for kind in ("bigint", "double"):
        if kind not in frequencies:
            continue
        f = frequencies[kind].select("column_name", "value")
        ends = f.groupBy("column_name").agg(
            F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("k")
        )
        span = F.try_subtract(F.col("hi"), F.col("lo"))
        if kind == "bigint":
            step = F.when(F.col("k") >= 3, F.expr("try_subtract(hi, lo) div (k - 1)"))
            whole = F.lit(True)
        else:
            step = F.when(F.col("k") >= 3, span / (F.col("k") - 1))
            whole = F.col("value") % 1 == 0
        on_lattice = (
            whole
            & (F.col("step") > 0)
            & (F.try_subtract(F.col("value"), F.col("lo")) % F.nullif(F.col("step"), F.lit(0)) == 0)
            & (span == F.col("step") * (F.col("k") - 1))
        )
        parts.append(
            f.join(F.broadcast(ends.withColumn("step", step)), "column_name")
            .groupBy("column_name")
            .agg((count_where(F.coalesce(on_lattice, F.lit(False))) == F.count("*")).alias("is_sequential"))
        )
    return union_all(parts)
