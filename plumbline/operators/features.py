"""Imputers, encoders and scalers with an explicit fit boundary.

Statistics are computed by aggregation on the fit rows only and applied as expressions or as a
lookup; additive statistics of "all other folds" are the total minus the own fold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.joins import lookup
from plumbline.functions.ranking import running_totals
from plumbline.profile.univariate import exact_quantiles, union_all

NUMERIC_FILL = -999.0
CATEGORY_FILL = "__MISSING__"
SMOOTHING = 10.0


@dataclass(frozen=True)
class ColumnSpec:
    """What a plan asks for one column."""

    name: str
    imputation: str = "none"
    encoding: str = "none"
    scaling: str = "none"
    add_indicator: bool = False


def numeric_values(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], list(names), "column_name", "value")


def fit_numeric(df: DataFrame, names: Sequence[str], quartiles: bool = True) -> dict[str, dict[str, float]]:
    """mean, standard deviation (ddof 0), min, max, missing count and quartiles per column."""
    values = numeric_values(df, names)
    v = F.col("value")
    rows = (
        values.groupBy("column_name")
        .agg(
            F.avg(v).alias("mean"),
            F.stddev_pop(v).alias("std"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            (F.count("*") - F.count(v)).alias("missing"),
        )
        .collect()
    )
    stats = {r["column_name"]: r.asDict() for r in rows}
    if quartiles:
        for r in exact_quantiles(values, (0.25, 0.5, 0.75)).collect():
            stats[r["column_name"]][{0.25: "q1", 0.5: "median", 0.75: "q3"}[r["prob"]]] = r["quantile"]
    return stats


def fit_modes(df: DataFrame, names: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per column, the smallest on ties."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in names]).unpivot(
        [], list(names), "column_name", "value"
    )
    counted = long.where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    best = counted.groupBy("column_name").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("b"))
    return {r["column_name"]: r["v"] for r in best.select("column_name", F.col("b.value").alias("v")).collect()}


def impute(column: Column, strategy: str, numeric: bool, stats: dict | None = None, mode: str | None = None) -> Column:
    if strategy == "none":
        return column
    if strategy == "constant":
        return F.coalesce(column, F.lit(NUMERIC_FILL if numeric else CATEGORY_FILL))
    if strategy in ("mean", "median"):
        return F.coalesce(column.cast("double"), F.lit(stats[strategy]))
    if strategy == "mode":
        return F.coalesce(column, F.lit(mode))
    raise ValueError(f"unsupported imputation: {strategy}")


def scale(column: Column, method: str, stats: dict) -> Column:
    """Standard (ddof 0), min-max or robust scaling; a zero scale divides by one."""

    def over(center, width):
        return (column - F.lit(center)) / F.lit(width if width else 1.0)

    if method == "none":
        return column
    if method == "standard":
        return over(stats["mean"], stats["std"])
    if method == "minmax":
        return over(stats["min"], stats["max"] - stats["min"])
    if method == "robust":
        return over(stats["median"], stats["q3"] - stats["q1"])
    raise ValueError(f"unsupported scaling: {method}")


def category_text(column: Column, numeric: bool) -> Column:
    """Numeric category codes as text; NULL stays NULL."""
    return column.cast("double").cast("string") if numeric else column.cast("string")


def vocabulary(df: DataFrame, name: str) -> list[str]:
    """Sorted categories, all of them, for one column each: as many names as the result has columns."""
    found = df.select(F.col(name).cast("string").alias("v")).where("v is not null").distinct().collect()
    return sorted(r["v"] for r in found)


def one_hot(column: Column, categories: Sequence[str], prefix: str) -> list[Column]:
    """One 0/1 column per known category; an unknown value is all zeros."""
    text = column.cast("string")
    return [F.coalesce((text == c).cast("int"), F.lit(0)).alias(f"{prefix}_{c}") for c in categories]


def with_codes(df: DataFrame, text: Column, codes: DataFrame, output: str) -> DataFrame:
    """``df`` with the code of ``text`` in a table (label, code); unknown and missing are NULL."""
    label = codes.columns[0]
    keyed = codes.select(F.col(label).cast("string").alias(f"_text_{output}"), F.col("code").alias(output))
    found = lookup(df.withColumn(f"_text_{output}", text.cast("string")), keyed, [f"_text_{output}"])
    return found.select(*[F.col(f"`{c}`") for c in df.columns], output)


def ordinal(df: DataFrame, text: Column, codes: DataFrame, output: str) -> DataFrame:
    """Adds the position among the sorted categories of ``codes``, a table of any length; unknown is -1."""
    return with_codes(df, text, codes, output).withColumn(output, F.coalesce(output, F.lit(-1)))


def one_hot_vector(df: DataFrame, text: Column, codes: DataFrame, output: str) -> DataFrame:
    """Adds a sparse 0/1 vector by category index, for any number of categories; unknown is all zeros."""
    size = codes.count()
    if not size:
        return df.withColumn(output, array_to_vector(F.array().cast("array<double>")))
    index = f"_index_{output}"
    found = with_codes(df, text, codes, index).withColumn(index, F.coalesce(index, F.lit(size)).cast("double"))
    # An index beyond the known ones is kept as the last place, which is dropped.
    encoder = OneHotEncoder(inputCol=index, outputCol=output, handleInvalid="keep", dropLast=True)
    return encoder.fit(codes.select(F.col("code").cast("double").alias(index))).transform(found).drop(index)


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """Sorted distinct labels numbered from zero: a table, of any length."""
    found = df.select(label).where(F.col(label).isNotNull()).distinct()
    one = F.lit(1).cast("bigint")
    ranked = running_totals(found.withColumn("_all", one).withColumn("_one", one), ["_all"], label, ["_one"])
    return ranked.select(label, (F.col("cum__one") - 1).alias("code"))


def target_encoding(fit: DataFrame, category: str, target: str) -> tuple[DataFrame, Column]:
    """Smoothed mean per category, and the prior for unseen or missing categories."""
    total = fit.agg(F.avg(F.col(target).cast("double")).alias("prior")).first()["prior"]
    prior = F.lit(total)
    weight = F.col("_n") / (F.col("_n") + SMOOTHING)
    stats = (
        fit.where(F.col(category).isNotNull())
        .groupBy(category)
        .agg(F.count(target).alias("_n"), F.avg(F.col(target).cast("double")).alias("_mean"))
        .select(category, (prior * (1.0 - weight) + F.col("_mean") * weight).alias("encoded"))
    )
    return stats, prior


def apply_target_encoding(df: DataFrame, stats: DataFrame, category: str, prior: Column, output: str) -> DataFrame:
    """A hot category is spread by the lookup; missing and unseen categories get the prior."""
    return (
        lookup(df, stats, [category])
        .withColumn(output, F.coalesce(F.col("encoded"), prior))
        .drop("encoded")
    )


def out_of_fold_encoding(df: DataFrame, category: str, target: str, fold: str, output: str) -> DataFrame:
    """Every row encoded from the other folds only, in one pass over the data.

    Sums per (category, fold) minus the own fold give the statistics of the others; so does the
    prior. No fold is scanned again, and the table joined has one row per category and fold.
    """
    y = F.col(target).cast("double")
    cells = df.groupBy(category, fold).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    present = cells.where(F.col(category).isNotNull())
    # NULL categories count in the prior only.
    totals = {r[fold]: (r["s"] or 0.0, r["n"]) for r in cells.groupBy(fold).agg(
        F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    if sum(n for _, n in totals.values()) < 2 or len(totals) < 2:
        raise ValueError("out-of-fold encoding needs at least two rows in at least two folds")
    s_all, n_all = sum(s for s, _ in totals.values()), sum(n for _, n in totals.values())
    priors = {f: (s_all - s) / (n_all - n) for f, (s, n) in totals.items()}
    prior = F.element_at(F.create_map(*[x for f, p in priors.items() for x in (F.lit(f), F.lit(p))]), F.col(fold))
    per_category = present.groupBy(category).agg(F.sum("s").alias("_s"), F.sum("n").alias("_n"))
    n_rest, s_rest = F.col("_n") - F.col("n"), F.col("_s") - F.col("s")
    weight = n_rest / (n_rest + SMOOTHING)
    encoded = prior * (1.0 - weight) + s_rest / (n_rest + SMOOTHING)
    stats = present.join(per_category, category).select(category, fold, encoded.alias("_encoded"))
    return (
        lookup(df, stats, [category, fold])
        .withColumn(output, F.coalesce(F.col("_encoded"), prior))
        .drop("_encoded")
    )


def nested_encoding(
    df: DataFrame, category: str, target: str, outer: str, inner: str, folds: int, output: str
) -> DataFrame:
    """The training rows of every outer fold, encoded from the other inner folds of the same training side.

    Adds ``held_out`` (the outer fold left out; a row is in the training side of all but its own) and the
    encoded value. One table of sums by (category, outer, inner) serves all: what is left is the total less
    the outer fold, less the inner one, plus both, so no fold is scanned again. The prior of a training side
    and inner fold comes the same way from the rows of all categories, missing ones included. The result has
    ``folds`` - 1 rows for each; ``outer`` and ``inner`` are numbers from 0. Where nothing is left the prior is NULL.
    """
    y = F.col(target).cast("double")
    cells = df.groupBy(category, outer, inner).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    all_ = cells.groupBy(outer, inner).agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"), F.sum("n").alias("n")).collect()
    sums = {(r[outer], r[inner]): (r["s"], r["n"]) for r in all_}
    priors = {}
    inners = sorted({i for _, i in sums})
    for held_out in range(folds):
        for own in inners:
            left = [v for (o, i), v in sums.items() if o != held_out and i != own]
            n = sum(v[1] for v in left)
            priors[held_out, own] = sum(v[0] for v in left) / n if n else None

    # Margins of the cells of a category, side by side with each of its cells.
    present = cells.where(F.col(category).isNotNull()).withColumn("s", F.coalesce("s", F.lit(0.0)))
    margins = present.groupBy(category).agg(
        F.sum("s").alias("_s"),
        F.sum("n").alias("_n"),
        # At most one entry for each pair of folds.
        F.collect_list(F.struct(F.col(outer).alias("o"), F.col(inner).alias("i"), "s", "n")).alias("_cells"),
    )
    numbers = F.array(*[F.lit(f) for f in range(folds)])
    pairs = margins.withColumn("held_out", F.explode(numbers)).withColumn(
        inner, F.explode(F.array_distinct(F.transform("_cells", lambda c: c["i"])))
    )

    def summed(field, test):
        return F.aggregate(F.filter("_cells", test), F.lit(0).cast("double"), lambda t, c: t + c[field])

    def left_over(field, whole):
        outside = summed(field, lambda c: c["o"] == F.col("held_out"))
        inside = summed(field, lambda c: c["i"] == F.col(inner))
        both = summed(field, lambda c: (c["o"] == F.col("held_out")) & (c["i"] == F.col(inner)))
        return F.col(whole) - outside - inside + both

    known = pairs.select(
        category, "held_out", inner, left_over("s", "_s").alias("_left_s"), left_over("n", "_n").alias("_left_n")
    )
    entries = [F.struct(F.lit(h).alias("held_out"), F.lit(i).alias("i"), F.lit(p).cast("double").alias("p")) for (h, i), p in priors.items()]
    prior = F.element_at(
        F.transform(
            F.filter(F.array(*entries), lambda e: (e["held_out"] == F.col("held_out")) & (e["i"] == F.col(inner))), lambda e: e["p"]
        ),
        1,
    )
    sides = df.withColumn("held_out", F.explode(numbers)).where(F.col("held_out") != F.col(outer))
    weight = F.coalesce(F.col("_left_n") / (F.col("_left_n") + SMOOTHING), F.lit(0.0))
    encoded = prior * (1.0 - weight) + F.coalesce(F.col("_left_s") / (F.col("_left_n") + SMOOTHING), F.lit(0.0))
    return lookup(sides, known, [category, "held_out", inner]).withColumn(output, encoded).drop("_left_s", "_left_n")


def fold_means(df: DataFrame, names: Sequence[str], fold: str) -> DataFrame:
    """Mean and standard deviation of the rows outside each fold, as total minus own fold."""
    parts = []
    for name in names:
        x = F.col(name).cast("double")
        parts.append(
            df.groupBy(fold)
            .agg(F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.count(x).alias("n"))
            .withColumn("column_name", F.lit(name))
        )
    cells = union_all(parts)
    total = cells.groupBy("column_name").agg(
        F.sum("s").alias("all_s"), F.sum("q").alias("all_q"), F.sum("n").alias("all_n")
    )
    n, s, q = F.col("all_n") - F.col("n"), F.col("all_s") - F.col("s"), F.col("all_q") - F.col("q")
    mean = F.try_divide(s, n)
    return cells.join(F.broadcast(total), "column_name").select(
        "column_name", fold, n.alias("n"), mean.alias("mean"),
        F.sqrt(F.greatest(F.lit(0.0), F.try_divide(q, n) - mean * mean)).alias("std"),
    )


@dataclass(frozen=True)
class FittedColumns:
    """Feature expressions whose statistics come from the fit rows."""

    outputs: tuple[Column, ...]
    #: (encoder, text, codes, column that ``outputs`` take the code from)
    coded: tuple[tuple[Callable, Column, DataFrame, str], ...] = ()

    def apply(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        for encoder, text, codes, output in self.coded:
            df = encoder(df, text, codes, output)
        return df.select(*keep, *self.outputs)


def transform(fit: DataFrame, df: DataFrame, specs: Sequence[ColumnSpec], keep: Sequence[str]) -> DataFrame:
    """The planned features of ``df`` with all statistics taken from ``fit``; unplanned columns go."""
    return fit_columns(fit, specs).apply(df, keep)


def fit_columns(fit: DataFrame, specs: Sequence[ColumnSpec]) -> FittedColumns:
    """Fits imputers, encoders and scalers.

    Target encoding is a separate step (``out_of_fold_encoding`` on fit rows,
    ``apply_target_encoding`` on others), since it needs the target.
    """
    kinds = dict(fit.dtypes)
    numeric = {s.name for s in specs if kinds[s.name] not in ("string", "boolean")}
    measured = [s.name for s in specs if s.name in numeric and s.encoding == "none"]
    stats = fit_numeric(fit, measured) if measured else {}
    coded = [s for s in specs if s.encoding in ("onehot", "onehot_vector", "ordinal")]
    by_mode = [s.name for s in coded if s.imputation == "mode"]
    modes = fit_modes(fit, by_mode) if by_mode else {}
    gaps = fit.agg(*[F.count_if(F.col(s.name).isNull()).alias(s.name) for s in specs]).first().asDict()
    stats = stats | _filled_statistics(fit, specs, stats, gaps)
    outputs: list[Column] = []
    tables: list[tuple[Callable, Column, DataFrame, str]] = []
    encoders = {"ordinal": ordinal, "onehot_vector": one_hot_vector}
    for spec in specs:
        column, is_number = F.col(spec.name), spec.name in numeric
        if spec.add_indicator and spec.imputation != "none" and gaps[spec.name]:
            outputs.append(column.isNull().cast("int").alias(f"{spec.name}_missing"))
        if spec.encoding == "none":
            own = stats.get(spec.name, {})
            filled = impute(column, spec.imputation, is_number, own.get("unfilled", own))
            outputs.append(scale(filled, spec.scaling, own).alias(spec.name))
            continue
        text = impute(category_text(column, is_number), spec.imputation, False, mode=modes.get(spec.name))
        known = fit.select(text.alias(spec.name))
        if spec.encoding == "onehot":
            outputs += one_hot(text, vocabulary(known, spec.name), spec.name)
        elif spec.encoding in encoders:
            made = f"_coded_{spec.name}"
            tables.append((encoders[spec.encoding], text, label_codes(known, spec.name), made))
            outputs.append(F.col(f"`{made}`").alias(spec.name))
        else:
            outputs.append(text.alias(spec.name))
    return FittedColumns(tuple(outputs), tuple(tables))


def _filled_statistics(fit: DataFrame, specs: Sequence[ColumnSpec], stats: dict, gaps: dict) -> dict:
    """Scaler statistics after imputation (the scaler sees the filled values), for columns with gaps."""
    wanted = [
        s for s in specs if s.scaling != "none" and s.imputation != "none" and s.encoding == "none" and gaps[s.name]
    ]
    if not wanted:
        return {}
    filled = fit.select(*[impute(F.col(s.name), s.imputation, True, stats[s.name]).alias(s.name) for s in wanted])
    return {c: v | {"unfilled": stats[c]} for c, v in fit_numeric(filled, [s.name for s in wanted]).items()}
