"""The dataset profile: one wide row per column, its flags, and the long metric table.

Each pass aggregates on the cluster; what reaches the driver is one row per column or per column
pair, so its size depends on the schema alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import adjusted_skew, finite
from plumbline.plans.preprocessing import duplicate_groups
from plumbline.profile import associations as assoc
from plumbline.profile import univariate as uni
from plumbline.profile.columns import Columns, classify, normalize
from plumbline.session import shared_dir

# Thresholds of the profile flags.
HIGH_CARDINALITY = 15
ID_UNIQUENESS = 0.95
HIGH_MISSING = 40.0
MODERATE_MISSING = 5.0
MULTICOLLINEAR_VIF = 10.0
SKEWED = 1.0
LEAKAGE = 0.95
INFORMATIVE_MISSING = 0.3
LEAKING_MISSING = 0.7
LOW_VARIATION = 0.01
CATEGORY_CODES = 10

WIDE_SCHEMA = (
    "entity string, ordinal int, column_name string, dtype string, kind string, is_target boolean, "
    "n_rows bigint, n bigint, nunique bigint, top_n bigint, mean double, std double, min double, max double, "
    "median double, skew double, kurtosis double, iqr_outlier_pct double, nonzero_pct double, "
    "is_zero_inflated boolean, is_whole boolean, is_sequential boolean, corr_with_target double, "
    "max_abs_corr_other double, vif double, missingness_target_corr double, "
    "missingness_cluster_corr_max double, duplicate_of string"
)

NUMBER_METRICS = (
    "nunique", "missing_pct", "mean", "std", "min", "max", "median", "skew", "kurtosis", "iqr_outlier_pct",
    "nonzero_pct", "top_category_pct", "corr_with_target", "max_abs_corr_other", "vif",
    "missingness_target_corr", "missingness_cluster_corr_max",
)
FLAG_METRICS = (
    "has_missing", "is_sequential", "is_high_cardinality", "is_constant", "is_id_like", "has_high_missing",
    "has_moderate_missing", "is_multicollinear", "is_skewed", "is_zero_inflated", "leakage_suspect",
    "missingness_informative", "missingness_leakage_suspect", "is_low_variance", "is_numeric_but_categorical",
    "is_duplicate_of_other_column",
)
TEXT_METRICS = ("dtype", "duplicate_of")


def task_class(task_type: str) -> str:
    normalized = task_type.lower().strip()
    if normalized in ("binary", "multiclass", "classification"):
        return "classification"
    if normalized == "regression":
        return normalized
    raise ValueError("task_type must be 'classification', 'binary', 'multiclass' or 'regression'")


def _by_column(frame: DataFrame) -> dict[str, dict]:
    return {row["column_name"]: row.asDict() for row in frame.collect()}


def duplicate_columns(df: DataFrame, columns: Columns, pairs: Sequence) -> dict[str, str]:
    """First other column, in schema order, that repeats each column."""
    prints: dict[tuple, list[str]] = {}
    for row in assoc.fingerprints(df, columns).collect():
        prints.setdefault((row["dtype"], row["n"], row["content"], row["checksum"]), []).append(row["column_name"])
    rank = {c: i for i, c in enumerate(columns.order)}
    exact = []
    for group in prints.values():
        # Equality is transitive, so each member is compared with the first one only.
        first, *rest = sorted(group, key=rank.get)
        exact += [(first, other) for other in rest]
    near = [
        (p["left_name"], p["right_name"])
        for p in pairs
        if p["correlation"] is not None and p["correlation"] > assoc.DUPLICATE_CORRELATION
    ]
    verified = assoc.verify_duplicates(df, exact, near).where("duplicate").collect() if exact or near else []
    exact_pairs = set(exact)
    matches: dict[str, set[str]] = {}
    classes: dict[str, set[str]] = {}
    for row in verified:
        a, b = row["left_name"], row["right_name"]
        if (a, b) in exact_pairs:
            classes.setdefault(a, {a}).add(b)
        matches.setdefault(a, set()).add(b)
        matches.setdefault(b, set()).add(a)
    for members in classes.values():
        for member in members:
            matches.setdefault(member, set()).update(members - {member})
    return {c: min(others, key=rank.get) for c, others in matches.items()}


def vif_candidates(columns: Columns, target: str, duplicate_of: dict[str, str], nunique: dict[str, int]) -> list[str]:
    """Numeric columns that vary, without the target; of each class of duplicates only the first."""
    later: set[str] = set()
    for members in duplicate_groups(duplicate_of.items()):
        later.update([c for c in columns.numeric if c in members][1:])
    return [c for c in columns.numeric if c != target and c not in later and nunique.get(c, 0) > 1]


def inflation_factors(df: DataFrame, names: Sequence[str], stats: dict[str, dict]) -> dict[str, float | None]:
    """VIF from the correlations of the median-imputed columns."""
    if len(names) < 2:
        return {}
    infinite = F.lit(float("inf"))
    filled = df.select(
        *[
            F.coalesce(
                F.when(F.abs(F.col(f"`{c}`").cast("double")) != infinite, F.col(f"`{c}`").cast("double")),
                F.lit(float(stats[c]["median"])),
            ).alias(c)
            for c in names
        ]
    )
    matrix = np.eye(len(names))
    position = {c: i for i, c in enumerate(names)}
    for row in assoc.pair_correlations(filled, names, {c: stats[c]["mean"] for c in names}).collect():
        i, j = position[row["left_name"]], position[row["right_name"]]
        matrix[i, j] = matrix[j, i] = row["correlation"] if row["correlation"] is not None else 0.0
    return dict(zip(names, assoc.variance_inflation(matrix)))


def column_statistics(df: DataFrame, target: str, entity: str = "dataset") -> DataFrame:
    """One row per column with every statistic the flags are derived from."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} is not in the dataset")
    spark = df.sparkSession
    df = normalize(df)
    columns = classify(df)
    stats = {c: {"dtype": columns.dtypes[c], "n_rows": 0, "n": 0, "is_whole": False} for c in columns.order}

    def add(frame, rename=None):
        for name, row in _by_column(frame).items():
            stats[name].update({(rename or {}).get(k, k): v for k, v in row.items() if k != "column_name"})

    add(uni.moments(df, columns))
    others = [c for c in columns.order if c != target]
    gappy = [c for c in columns.order if 0 < stats[c]["n"] < stats[c]["n_rows"]]
    pairs: list = []
    duplicate_of: dict[str, str] = {}

    def distributions():
        frequencies = {k: f.persist() for k, f in uni.value_frequencies(df, columns).items()}
        add(uni.frequency_summary(frequencies).drop("n"))
        if columns.numeric:
            add(uni.outlier_profile(uni.spread(uni.numeric_values(df, columns))))
            add(uni.sequential(frequencies))
        for frame in frequencies.values():
            frame.unpersist()

    def target_categories():
        names = [c for c in others if not (columns.is_numeric(c) and columns.is_numeric(target))]
        if names:
            cells = assoc.contingency(df, names, target, columns)
            add(assoc.cramers_v(cells), {"association": "corr_with_target"})

    def missingness():
        names = [c for c in gappy if c != target]
        if names and columns.is_numeric(target):
            marks = assoc.target_pearson(df, names, target, missing=True)
            add(marks, {"association": "missingness_target_corr"})
        elif names:
            marks = assoc.cramers_v(assoc.missing_contingency(df, names, target, columns))
            add(marks, {"association": "missingness_target_corr"})
        if len(gappy) > 1:
            clusters = assoc.pair_correlations(assoc.missing_indicators(df, gappy), gappy)
            add(assoc.strongest(clusters), {"strongest": "missingness_cluster_corr_max"})

    def numeric_pairs():
        centers = {c: stats[c].get("mean") for c in columns.numeric}
        pairs.extend(assoc.pair_correlations(df, columns.numeric, centers).collect())
        duplicate_of.update(duplicate_columns(df, columns, pairs))

    # The passes are independent jobs; submitting them together keeps the cluster busy.
    with ThreadPoolExecutor(max_workers=4) as pool:
        for done in [pool.submit(f) for f in (distributions, target_categories, missingness, numeric_pairs)]:
            done.result()

    for pair in pairs:
        a, b, r = pair["left_name"], pair["right_name"], pair["correlation"]
        if r is None:
            continue
        for name, other in ((a, b), (b, a)):
            stats[name]["max_abs_corr_other"] = max(stats[name].get("max_abs_corr_other") or 0.0, abs(r))
            if other == target:
                stats[name]["corr_with_target"] = r
    nunique = {c: stats[c].get("nunique", 0) for c in columns.order}
    factors = inflation_factors(df, vif_candidates(columns, target, duplicate_of, nunique), stats)

    rows = []
    for i, c in enumerate(columns.order):
        s = stats[c]
        kind = "numeric" if columns.is_numeric(c) else "categorical" if c in columns.categorical else "other"
        rows.append(
            {
                "entity": entity,
                "ordinal": i,
                "column_name": c,
                "kind": kind,
                "is_target": c == target,
                **s,
                "nunique": s.get("nunique", 0),
                "top_n": s.get("top_n"),
                "is_zero_inflated": s.get("is_zero_inflated", False),
                "is_sequential": s.get("is_sequential", False),
                "duplicate_of": duplicate_of.get(c),
                "vif": factors.get(c),
            }
        )
    names = [part.split()[0] for part in WIDE_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(k) for k in names) for r in rows], WIDE_SCHEMA)


def with_flags(stats: DataFrame) -> DataFrame:
    """Percentages, rounded as reported, and the flags; several datasets may share one table."""
    n_rows, n, k = F.col("n_rows"), F.col("n"), F.col("nunique")
    numeric, categorical = F.col("kind") == "numeric", F.col("kind") == "categorical"
    missing_share = F.try_divide((n_rows - n).cast("double"), n_rows.cast("double"))
    uniqueness = F.try_divide(k.cast("double"), n_rows.cast("double"))
    target = F.col("is_target")

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    low = numeric & (k > 1) & (uniqueness < 0.5) & (F.col("std") / (F.abs("mean") + 1e-8) < LOW_VARIATION)
    missing_corr = F.abs("missingness_target_corr")
    return stats.withColumns(
        {
            "missing_pct": F.round(missing_share * 100.0, 2),
            "top_category_pct": F.when(
                categorical, F.round(F.try_divide(F.col("top_n").cast("double"), n.cast("double")) * 100.0, 2)
            ),
        }
    ).withColumns(
        {
            "has_missing": n < n_rows,
            "is_high_cardinality": flag(categorical & (k > HIGH_CARDINALITY)),
            "is_constant": k <= 1,
            "is_id_like": flag((uniqueness > ID_UNIQUENESS) & (F.col("is_whole") | categorical)),
            "has_high_missing": flag(F.col("missing_pct") > HIGH_MISSING),
            "has_moderate_missing": flag(
                (F.col("missing_pct") > MODERATE_MISSING) & (F.col("missing_pct") <= HIGH_MISSING)
            ),
            "is_multicollinear": flag(F.col("vif") > MULTICOLLINEAR_VIF),
            "is_skewed": flag(F.abs("skew") > SKEWED),
            "leakage_suspect": F.when(~target, flag(F.abs("corr_with_target") > LEAKAGE)),
            "missingness_informative": flag(missing_corr > INFORMATIVE_MISSING),
            "missingness_leakage_suspect": flag(missing_corr > LEAKING_MISSING),
            "is_low_variance": flag(low),
            "is_numeric_but_categorical": flag(numeric & (k <= CATEGORY_CODES) & F.col("is_whole")),
            "is_duplicate_of_other_column": F.col("duplicate_of").isNotNull(),
        }
    )


def digested(df: DataFrame) -> DataFrame:
    """(_a, _b, _row): 128 bits of each row, NULLs marked apart, and the row itself."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    return df.select(
        F.xxhash64(nulls, *columns).alias("_a"), F.xxhash64(F.lit(7), *columns[::-1], nulls).alias("_b"), F.struct(*columns).alias("_row")
    )


def stored(df: DataFrame, label: str) -> DataFrame:
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def duplicate_rows(df: DataFrame, digests: Callable[[DataFrame], DataFrame] = digested) -> DataFrame:
    """distinct_rows, n_rows and n_duplicated_rows (rows beyond the first of each identical group).

    Only digests are shuffled at first. Where they meet, the rows behind them are compared in full: the least and
    the greatest row of a digest are equal unless different rows share it, and the rows of such digests alone are
    counted by their values.
    """
    rows = digests(df)
    counted = stored(rows.groupBy("_a", "_b").agg(F.count("*").alias("_copies")), "digests")
    again = counted.where("_copies > 1").select("_a", "_b")
    ends = (
        rows.join(again, ["_a", "_b"], "left_semi")
        .groupBy("_a", "_b")
        .agg(F.min("_row").alias("_low"), F.max("_row").alias("_high"))
    )
    mixed = stored(ends.where(~F.col("_low").eqNullSafe(F.col("_high"))).select("_a", "_b"), "mixed")
    apart = rows.join(mixed, ["_a", "_b"], "left_semi").groupBy("_row").agg(F.count("*").alias("_copies")).select("_copies")
    whole = counted.join(mixed, ["_a", "_b"], "left_anti").select("_copies").unionByName(apart)
    return whole.agg(
        F.count("*").alias("distinct_rows"),
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("n_duplicated_rows"),
    )


def dataset_metrics(df: DataFrame, target: str, task_type: str, entity: str = "dataset") -> DataFrame:
    """Dataset- and target-level metrics as long rows."""
    task = task_class(task_type)
    df = normalize(df)
    columns = classify(df)
    size = duplicate_rows(df).select("n_rows", "n_duplicated_rows")
    if task == "classification":
        counts = assoc.class_counts(df, target)
        label = category_label(columns, target)
        entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "share"))))
        balance = assoc.class_balance(counts).agg(entries.alias("balance"))
        skew = F.lit(None).cast("double")
        imbalanced = assoc.is_imbalanced(counts)
    else:

        number = columns.is_numeric(target)
        value = finite(adjusted_skew(F.col(f"`{target}`").cast("double"))) if number else F.max(F.lit(None).cast("double"))
        balance = df.agg(value.alias("target_skew")).withColumn("balance", F.lit(None).cast("map<string,double>"))
        skew = F.col("target_skew")
        imbalanced = size.select(F.lit(None).cast("boolean").alias("is_imbalanced"))
    one = size.join(F.broadcast(balance)).join(F.broadcast(imbalanced))
    metrics = [
        _metric("n_rows", num=F.col("n_rows")),
        _metric("n_cols", num=F.lit(len(columns.order))),
        _metric("n_duplicated_rows", num=F.col("n_duplicated_rows")),
        _metric("target_dtype", text=F.lit(columns.dtypes[target])),
        _metric("target_class_balance", mapping=F.col("balance")),
        _metric("target_skew", num=skew),
        _metric("target:is_imbalanced", flag=F.col("is_imbalanced")),
    ]
    return one.select(F.inline(F.array(*metrics))).select(
        F.lit(entity).alias("entity"), F.lit(None).cast("string").alias("column_name"), "*"
    )


def category_label(columns: Columns, target: str) -> Column:
    """Class labels as text; the missing class is named ``nan``."""
    return F.coalesce(F.col("value").cast("string"), F.lit("nan")).alias("label")


def _metric(key, num=None, flag=None, text=None, mapping=None, key_column=None) -> Column:
    kind = "number" if num is not None else "bool" if flag is not None else "str" if text is not None else "map"

    def typed(value, sql_type):
        return (F.lit(None) if value is None else value).cast(sql_type)

    return F.struct(
        F.lit(key.rsplit(":", 1)[-1]).alias("metric"),
        (F.lit(key) if key_column is None else key_column).alias("metric_key"),
        F.lit(kind).alias("value_type"),
        typed(num, "double").alias("num_value"),
        typed(flag, "boolean").alias("bool_value"),
        typed(text, "string").alias("str_value"),
        typed(mapping, "map<string,double>").alias("map_value"),
    )


def column_metrics(flagged: DataFrame) -> DataFrame:
    """The wide profile as long rows keyed ``col:{name}:{metric}``."""

    def key(metric):
        return F.concat(F.lit("col:"), F.col("column_name"), F.lit(f":{metric}"))

    rows = [_metric(m, num=F.col(m), key_column=key(m)) for m in NUMBER_METRICS]
    rows += [_metric(m, flag=F.col(m), key_column=key(m)) for m in FLAG_METRICS]
    rows += [_metric(m, text=F.col(m), key_column=key(m)) for m in TEXT_METRICS]
    return flagged.select("entity", "column_name", F.inline(F.array(*rows)))


def profile(df: DataFrame, target: str, task_type: str, entity: str = "dataset") -> DataFrame:
    """The long profile table of one dataset."""
    task_class(task_type)
    flagged = with_flags(column_statistics(df, target, entity))
    return dataset_metrics(df, target, task_type, entity).unionByName(column_metrics(flagged))


def save_profiles(datasets: dict[str, tuple[DataFrame, str, str]], path: str) -> None:
    """Profiles of several datasets in one table, a folder per dataset; a rerun replaces its folder."""
    for entity, (df, target, task_type) in datasets.items():
        profile(df, target, task_type, entity).drop("entity").write.mode("overwrite").parquet(f"{path}/entity={entity}")


def planted_defects(long_profile: DataFrame, added: Sequence[str]) -> DataFrame:
    """Columns among ``added`` that raise exactly one planted-defect flag each."""
    defect = F.create_map(
        F.lit("is_constant"), F.lit("constant"),
        F.lit("leakage_suspect"), F.lit("leakage"),
        F.lit("has_high_missing"), F.lit("high_missing"),
    )
    return (
        long_profile.where(F.col("bool_value") & F.col("column_name").isin(*added))
        .select("column_name", defect[F.col("metric")].alias("defect"))
        .where("defect is not null")
        .groupBy("defect")
        .agg(F.min("column_name").alias("column_name"), F.count("*").alias("matches"))
        .withColumn("unambiguous", F.col("matches") == 1)
    )
