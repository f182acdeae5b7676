"""Rule-derived preprocessing plans: drop, impute, encode, scale, override, metric choice.

Input is the flagged wide profile (``profile.dataset.with_flags``) of one or many datasets; every
rule is a CASE over its columns, so the plans of all datasets come from one pass.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVERRIDE_CAP = 3
ONEHOT_LIMIT = 15

# Drop reasons in the order the rules are tried.
DROP_REASONS = (
    "leakage_suspect",
    "missingness_leakage_suspect",
    "is_constant",
    "is_low_variance",
    "is_id_like",
    "is_duplicate_of_other_column",
    "has_high_missing",
)


def truth(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def duplicate_groups(edges: Iterable[tuple[str, str]]) -> list[set[str]]:
    """Connected components of the duplicate pairs of one dataset (at most one pair per column)."""
    root: dict[str, str] = {}

    def find(name):
        while root.setdefault(name, name) != name:
            name = root[name]
        return name

    for a, b in edges:
        root[find(a)] = find(b)
    groups: dict[str, set[str]] = {}
    for name in list(root):
        groups.setdefault(find(name), set()).add(name)
    return list(groups.values())


def mark_redundant(flagged: DataFrame) -> DataFrame:
    """Adds ``is_redundant``: every column of a duplicate group but its first in column order.

    The duplicate pairs are schema metadata (at most one per column), so the groups are formed on
    the driver.
    """
    pairs = flagged.where("duplicate_of is not null").select("entity", "column_name", "duplicate_of").collect()
    order = {}
    if pairs:
        names = flagged.select("entity", "column_name", "ordinal").collect()
        order = {(r["entity"], r["column_name"]): r["ordinal"] for r in names}
    edges: dict[str, list[tuple[str, str]]] = {}
    for row in pairs:
        edges.setdefault(row["entity"], []).append((row["column_name"], row["duplicate_of"]))
    redundant = [
        (entity, name)
        for entity, entity_edges in edges.items()
        for group in duplicate_groups(entity_edges)
        for name in sorted(group, key=lambda c: order.get((entity, c), len(order)))[1:]
    ]
    marks = flagged.sparkSession.createDataFrame(
        [(e, c, True) for e, c in redundant], "entity string, column_name string, _redundant boolean"
    )
    return (
        flagged.join(F.broadcast(marks), ["entity", "column_name"], "left")
        .withColumn("is_redundant", truth("_redundant"))
        .drop("_redundant")
    )


def drop_reason() -> Column:
    tests = {
        "is_duplicate_of_other_column": truth("is_redundant"),
        "has_high_missing": truth("has_high_missing") & ~truth("missingness_informative"),
    }
    chain = None
    for reason in DROP_REASONS:
        test = tests.get(reason, truth(reason))
        chain = F.when(test, reason) if chain is None else chain.when(test, reason)
    return chain


def effective_type() -> Column:
    categorical = (F.col("kind") == "categorical") | truth("is_numeric_but_categorical")
    return F.when(categorical, "categorical").otherwise("numeric")


def imputation() -> Column:
    numeric = F.col("effective_type") == "numeric"
    return (
        F.when(~truth("has_missing"), "none")
        .when(truth("missingness_informative"), "constant")
        .when(numeric & truth("is_skewed"), "median")
        .when(numeric, "mean")
        .when(F.coalesce(F.col("top_category_pct"), F.lit(0.0)) > 50.0, "mode")
        .otherwise("constant")
    )


def encoding() -> Column:
    return (
        F.when(F.col("effective_type") == "numeric", "none")
        .when(F.col("nunique") == 2, "ordinal")
        .when(F.col("nunique") <= ONEHOT_LIMIT, "onehot")
        .otherwise("target")
    )


def scaling() -> Column:
    outliers = F.coalesce(F.col("iqr_outlier_pct"), F.lit(0.0)) > 5.0
    return (
        F.when(F.col("effective_type") == "categorical", "none")
        .when(truth("is_zero_inflated") | outliers, "robust")
        .otherwise("standard")
    )


def action() -> Column:
    imputes = F.col("imputation") != "none"
    encodes = F.col("encoding") != "none"
    scales = F.col("scaling") != "none"
    return (
        F.when(imputes & encodes, "impute_and_encode")
        .when(imputes & scales, "impute_and_scale")
        .when(imputes, "impute")
        .when(encodes, "encode")
        .when(scales, "scale")
        .otherwise("passthrough")
    )


# Metrics a plan row cites, by drop reason or for a kept column.
DROP_EVIDENCE = {
    "leakage_suspect": ("leakage_suspect",),
    "missingness_leakage_suspect": ("missingness_leakage_suspect", "missingness_target_corr"),
    "is_constant": ("is_constant",),
    "is_low_variance": ("is_low_variance",),
    "is_id_like": ("is_id_like",),
    "is_duplicate_of_other_column": ("is_duplicate_of_other_column", "duplicate_of"),
    "has_high_missing": ("has_high_missing", "missingness_informative"),
}
KEEP_EVIDENCE = (
    "missing_pct",
    "has_missing",
    "missingness_informative",
    "is_skewed",
    "top_category_pct",
    "iqr_outlier_pct",
    "is_zero_inflated",
    "nonzero_pct",
    "is_numeric_but_categorical",
)


def evidence_keys() -> Column:
    def cited(metrics):
        return F.array(*[F.lit(m) for m in ("dtype", "nunique", *metrics)])

    names = cited(KEEP_EVIDENCE)
    for reason, metrics in DROP_EVIDENCE.items():
        names = F.when(F.col("drop_reason") == reason, cited(metrics)).otherwise(names)
    return F.transform(names, lambda m: F.concat(F.lit("col:"), F.col("column_name"), F.lit(":"), m))


def plan_defaults(flagged: DataFrame) -> DataFrame:
    """One plan row per column but the target, numbered in column order."""
    target_ordinal = F.max(F.when(F.col("is_target"), F.col("ordinal"))).over(Window.partitionBy("entity"))
    number = F.col("ordinal") + F.when(F.col("ordinal") < F.col("_target_ordinal"), 1).otherwise(0)
    planned = (
        mark_redundant(flagged)
        .withColumn("_target_ordinal", target_ordinal)
        .where(~F.col("is_target"))
        .withColumn("claim_id", F.format_string("prep_%03d", number))
        .withColumn("effective_type", effective_type())
        .withColumn("drop_reason", drop_reason())
    )
    dropped = F.col("drop_reason").isNotNull()
    for name, rule in (("imputation", imputation()), ("encoding", encoding()), ("scaling", scaling())):
        planned = planned.withColumn(name, F.when(dropped, "none").otherwise(rule))
    return planned.withColumn("action", F.when(dropped, "drop").otherwise(action())).select(
        "entity",
        "claim_id",
        "ordinal",
        "column_name",
        "effective_type",
        "action",
        "imputation",
        "encoding",
        "scaling",
        "drop_reason",
        truth("missingness_informative").alias("add_indicator"),
        (
            (F.col("action") == "impute_and_encode")
            & (F.col("encoding") == "onehot")
            & truth("is_numeric_but_categorical")
        ).alias("stringify"),
        evidence_keys().alias("evidence_keys"),
    )


def apply_overrides(plans: DataFrame, proposals: DataFrame, run: str = "run_id", cap: int = OVERRIDE_CAP) -> DataFrame:
    """Proposed transforms applied to kept columns, at most ``cap`` per run in plan order.

    ``plans`` and ``proposals`` share (run, column_name); the log column says why one was refused.
    The cut-off per run comes from a top-``cap`` ranking, which Spark limits before its shuffle.
    """
    keys = [run, "column_name"]
    transforms = ("imputation", "encoding", "scaling")
    proposed = proposals.select(*keys, *[F.col(t).alias(f"new_{t}") for t in transforms], "override_reason")
    joined = plans.join(proposed, keys, "left")
    differs = F.lit(False)
    for t in transforms:
        differs = differs | (F.col(f"new_{t}") != F.col(t))
    joined = joined.withColumn("_differs", F.coalesce(differs, F.lit(False)))
    wanted = joined.where(F.col("_differs") & (F.col("action") != "drop")).select(run, "ordinal")
    ranked = wanted.withColumn("_rn", F.row_number().over(Window.partitionBy(run).orderBy("ordinal")))
    cutoff = ranked.where(F.col("_rn") <= cap).groupBy(run).agg(F.max("ordinal").alias("_cutoff"))
    marked = joined.join(cutoff, run, "left")
    is_drop = F.col("action") == "drop"
    taken = F.col("_differs") & ~is_drop & (F.col("ordinal") <= F.col("_cutoff"))
    log = F.when(
        F.col("_differs") & is_drop, F.concat(F.lit("DROP_OVERRIDE_REJECTED:"), F.col("column_name"))
    ).when(F.col("_differs") & ~taken, F.concat(F.lit("OVERRIDE_CAP_REACHED:"), F.col("column_name")))
    result = marked.withColumn("is_override", F.coalesce(taken, F.lit(False))).withColumn("log", log)
    result = result.withColumn("rule_derived_action", F.col("action"))
    for t in transforms:
        result = result.withColumn(t, F.when(F.col("is_override"), F.col(f"new_{t}")).otherwise(F.col(t)))
    return (
        result.withColumn("action", F.when(F.col("is_override"), action()).otherwise(F.col("action")))
        .withColumn("override_reason", F.when(F.col("is_override"), F.col("override_reason")).otherwise(""))
        .drop("_differs", "_cutoff", *[f"new_{t}" for t in transforms])
    )


def override_summary(plans: DataFrame, by: str = "run_id") -> DataFrame:
    """Override rate and the columns kept and dropped per run."""
    return plans.groupBy(by).agg(
        F.count("*").alias("preprocess_claims"),
        F.avg(F.col("is_override").cast("double")).alias("override_rate"),
        F.count_if(F.col("action") == "drop").alias("columns_dropped"),
        F.count_if(F.col("action") != "drop").alias("columns_kept"),
    )


def metric_choice(task_type: Column, imbalanced: Column, target_skew: Column) -> tuple[Column, Column]:
    """Primary metric and the list of secondary metrics of a task."""
    heavy_tail = F.coalesce(target_skew, F.lit(0.0)) > 1.0
    skewed_classes = F.coalesce(imbalanced, F.lit(False))
    multiclass = task_type.isin("multiclass", "classification")

    def names(*metrics):
        return F.array(*[F.lit(m) for m in metrics])

    primary = (
        F.when((task_type == "binary") & skewed_classes, "pr_auc")
        .when(task_type == "binary", "roc_auc")
        .when(multiclass, "macro_f1")
        .when((task_type == "regression") & heavy_tail, "mae")
        .when(task_type == "regression", "rmse")
    )
    secondary = (
        F.when((task_type == "binary") & skewed_classes, names("f1", "roc_auc", "precision", "recall"))
        .when(task_type == "binary", names("f1", "accuracy"))
        .when(multiclass, names("balanced_accuracy", "per_class_f1"))
        .when((task_type == "regression") & heavy_tail, names("rmse", "r2"))
        .when(task_type == "regression", names("mae", "r2"))
    )
    return primary, secondary
