"""Fold assignment and model metrics as aggregations over scored rows.

Scored rows carry ``model_id``, ``fold``, the label ``y`` and a ``score`` or ``prediction``. Metric
tables are long: (model_id, fold, metric, value).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ranking import hash_rank, running_totals
from plumbline.functions.stats import ratio

GROUP = ("model_id", "fold")
ERROR_METRICS = ("mae", "rmse")
OVERFIT_GAP = 0.10
NEAR_PERFECT = 0.98


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5) -> DataFrame:
    """Fold 0..k-1 per row, each class dealt out evenly in hash order."""
    ranked = hash_rank(df, [label], key, "_rank", "fold")
    return ranked.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank")


def stratification_degraded(df: DataFrame, label: str, k: int = 5) -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(F.min("n").alias("smallest_class"), (F.min("n") < k).alias("stratification_degraded"))


def _long(frame: DataFrame, metrics: dict[str, Column], by: Sequence[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in metrics.items()])
    return frame.select(*by, F.inline(rows))


def ranking_metrics(scored: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """roc_auc (ties at mid-rank) and pr_auc (average precision); NULL with one class only.

    Rows collapse to one per distinct score first; running totals are bucketed, so a fold of any
    size is spread over many tasks.
    """
    by = list(by)
    groups = scored.groupBy(*by, F.col("score").cast("double").alias("score")).agg(
        F.count("*").cast("double").alias("n"), F.sum(F.col("y").cast("double")).alias("p")
    )
    r = running_totals(groups, by, "score", ["n", "p"])
    above_n = F.col("all_n") - F.col("cum_n") + F.col("n")
    above_p = F.col("all_p") - F.col("cum_p") + F.col("p")
    sums = r.groupBy(*by, "all_n", "all_p").agg(
        F.sum(F.col("p") * (F.col("cum_n") - (F.col("n") - 1.0) / 2.0)).alias("ranks"),
        F.sum(F.col("p") * above_p / above_n).alias("ap"),
    )
    p, n = F.col("all_p"), F.col("all_n")
    usable = (p > 0) & (p < n)
    auc = F.try_divide(F.col("ranks") - p * (p + 1.0) / 2.0, p * (n - p))
    return _long(
        sums,
        {"roc_auc": F.when(usable, auc), "pr_auc": F.when(usable, F.try_divide(F.col("ap"), p))},
        by,
    )


def binary_metrics(scored: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """f1, precision, recall and accuracy of 0/1 predictions; zero where undefined."""
    y, hat = F.col("y") == 1, F.col("prediction") == 1
    counts = scored.groupBy(*by).agg(
        F.count_if(y & hat).alias("tp"),
        F.count_if(~y & hat).alias("fp"),
        F.count_if(y & ~hat).alias("fn"),
        F.count("*").alias("n"),
    )
    tp, fp, fn, n = (F.col(c) for c in ("tp", "fp", "fn", "n"))

    def or_zero(value):
        return F.coalesce(value, F.lit(0.0))

    return _long(
        counts,
        {
            "f1": or_zero(ratio(2 * tp, 2 * tp + fp + fn)),
            "precision": or_zero(ratio(tp, tp + fp)),
            "recall": or_zero(ratio(tp, tp + fn)),
            "accuracy": ratio(n - fp - fn, n),
        },
        by,
    )


def class_metrics(scored: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """macro_f1, balanced_accuracy and per_class_f1:{label} from one confusion aggregation."""
    by = list(by)
    cells = scored.groupBy(*by, F.col("y").cast("string").alias("y"), F.col("prediction").cast("string").alias("h")).agg(
        F.count("*").alias("n")
    )
    zero = F.lit(0).cast("bigint")

    def side(label, actual, predicted, hit):
        return F.struct(
            label.alias("label"), actual.alias("actual"), predicted.alias("predicted"), hit.alias("hit")
        )

    n = F.col("n")
    hit = F.when(F.col("y") == F.col("h"), n).otherwise(zero)
    sides = cells.select(
        *by, F.inline(F.array(side(F.col("y"), n, zero, hit), side(F.col("h"), zero, n, zero)))
    )
    per_class = sides.groupBy(*by, "label").agg(
        F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit")
    )
    f1 = F.coalesce(ratio(2 * F.col("hit"), F.col("actual") + F.col("predicted")), F.lit(0.0))
    scored_classes = per_class.withColumns({"f1": f1, "recall": ratio(F.col("hit"), F.col("actual"))})
    macro = scored_classes.groupBy(*by).agg(F.avg("f1").alias("m"), F.avg("recall").alias("b"))
    single = scored_classes.select(
        *by, F.concat(F.lit("per_class_f1:"), "label").alias("metric"), F.col("f1").alias("value")
    )
    return _long(macro, {"macro_f1": F.col("m"), "balanced_accuracy": F.col("b")}, by).unionByName(single)


def regression_metrics(scored: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """mae, rmse and r2 in one aggregation."""
    y, e = F.col("y").cast("double"), F.col("y").cast("double") - F.col("prediction").cast("double")
    sums = scored.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(y).alias("variance")
    )
    r2 = 1.0 - F.try_divide(F.col("mse"), F.col("variance"))
    return _long(sums, {"mae": F.col("mae"), "rmse": F.sqrt("mse"), "r2": r2}, by)


def fold_summary(metrics: DataFrame) -> DataFrame:
    """Mean, population deviation and usable folds per model, split and metric."""
    value = F.when(~F.isnan("value"), F.col("value"))
    return metrics.groupBy("model_id", "split", "metric").agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("usable_folds")
    )


def overfitting(summary: DataFrame) -> DataFrame:
    """Train and validation means side by side.

    ``overfitting_flag`` tests train - validation for every metric, as reported; for error metrics
    that gap is negative when a model overfits, so ``overfitting_directed`` turns it around.
    """
    def of(split, column):
        return F.max(F.when(F.col("split") == split, F.col(column)))

    wide = summary.groupBy("model_id", "metric").agg(
        of("train", "mean").alias("train_score_mean"),
        of("validation", "mean").alias("val_score_mean"),
        of("validation", "std").alias("val_score_std"),
        of("validation", "usable_folds").alias("usable_folds"),
    )
    gap = F.col("train_score_mean") - F.col("val_score_mean")
    directed = F.when(F.col("metric").isin(*ERROR_METRICS), -gap).otherwise(gap)
    return wide.withColumns(
        {
            "train_val_gap": gap,
            "overfitting_flag": gap > OVERFIT_GAP,
            "overfitting_directed": directed > OVERFIT_GAP,
        }
    )


def best_model(evaluations: DataFrame, by: Sequence[str]) -> DataFrame:
    """Best model per group: smallest error or largest score, the first by rank on ties."""
    loss = F.when(F.col("primary_metric").isin(*ERROR_METRICS), F.col("primary_metric_mean")).otherwise(
        -F.col("primary_metric_mean")
    )
    pick = F.min_by(F.struct("model_id", "primary_metric_mean"), F.struct(loss, F.col("rank"), F.col("model_id")))
    best = evaluations.where("primary_metric_mean is not null").groupBy(*by).agg(pick.alias("_best"))
    return best.select(
        *by,
        F.col("_best.model_id").alias("best_model_id"),
        F.col("_best.primary_metric_mean").alias("best_primary_metric_value"),
    )


def model_ranking(choices: DataFrame, by: Sequence[str]) -> DataFrame:
    """Accepted models in rank order and the rejected one; model sets per run are small by design."""
    kept = F.when(~F.col("is_rejection"), F.struct(F.coalesce(F.col("rank"), F.lit(99)).alias("rank"), "model_id"))
    ordered = F.array_sort(F.collect_set(kept))
    return choices.groupBy(*by).agg(
        F.transform(ordered, lambda m: m["model_id"]).alias("ranking"),
        F.min(F.when(F.col("is_rejection"), F.col("model_id"))).alias("rejected"),
    )


def near_perfect(evaluations: DataFrame) -> DataFrame:
    """Classification results too good to trust."""
    return evaluations.where((F.col("task_type") != "regression") & (F.col("mean") >= NEAR_PERFECT))
