"""Gold tables and the reports on them.

Every table is aggregated to run grain before it meets ``runs``: a run that holds most of the rows
is then one row per task, and the join with ``runs`` moves summaries only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.stats import count_where, ratio
from plumbline.plans.audit import ACCURATE, MISSTATED, citation_counts

SCORES = (0, 1, 2, 3)


def verdict_rates(evidence_verdicts: DataFrame, claims: DataFrame, runs: DataFrame) -> DataFrame:
    """Evidence counts and rates by dataset and stage."""
    keys = ["run_id", "claim_id"]
    per_claim = citation_counts(evidence_verdicts, keys)
    counts = ("citations", "accurate", "misstated", "fabricated")
    per_run = (
        per_claim.join(claims.select(*keys, "stage"), keys)
        .groupBy("run_id", "stage")
        .agg(*[F.sum(c).alias(c) for c in counts])
    )
    grouped = (
        per_run.join(runs.select("run_id", "dataset"), "run_id")
        .groupBy("dataset", "stage")
        .agg(*[F.sum(c).alias(c) for c in counts])
    )
    total = F.col("citations")
    return grouped.select(
        "dataset",
        "stage",
        total.alias("evidence_count"),
        F.col("accurate").alias("accurate_count"),
        F.col("misstated").alias("misstated_count"),
        F.col("fabricated").alias("fabricated_count"),
        ratio(F.col("accurate"), total).alias("accuracy_rate"),
        ratio(F.col("misstated"), total).alias("misstatement_rate"),
        ratio(F.col("fabricated"), total).alias("fabrication_rate"),
    )


def _score_aggregates() -> list[Column]:
    code, score = F.col("claim_layer1_code"), F.col("layer2_score")
    return [
        F.count("*").alias("claim_count"),
        count_where(code == ACCURATE).alias("layer1_eligible_count"),
        F.count(score).alias("layer2_claim_count"),
        F.sum(score).alias("_score_sum"),
        *[count_where(score == s).alias(f"score_{s}_count") for s in SCORES],
        count_where((code == ACCURATE) & score.isNull()).alias("eligible_missing_layer2_count"),
        count_where((code != ACCURATE) & score.isNotNull()).alias("ineligible_with_layer2_count"),
        count_where((code == MISSTATED) & score.isNull()).alias("evidence_misstated_excluded_count"),
    ]


def layer2_scores(enriched: DataFrame, runs: DataFrame) -> DataFrame:
    """Score histogram, mean and gate counts by dataset, stage and temperature."""
    per_run = enriched.groupBy("run_id", "stage").agg(*_score_aggregates())
    sums = [c for c in per_run.columns if c not in ("run_id", "stage")]
    grouped = (
        per_run.join(runs.select("run_id", "dataset", "temperature"), "run_id")
        .groupBy("dataset", "stage", "temperature")
        .agg(*[F.sum(c).alias(c) for c in sums])
    )
    return grouped.withColumn(
        "mean_layer2_score", ratio(F.col("_score_sum"), F.col("layer2_claim_count"))
    ).drop("_score_sum")


def detection(defects: DataFrame, runs: DataFrame) -> DataFrame:
    """Planted and detected defects with the columns missed; a NULL outcome counts as neither."""
    outcomes = (F.count("*").alias("n"), F.sum(F.col("recalled").cast("bigint")).alias("hits"))
    per_run = defects.groupBy("run_id", "defect", "column_name").agg(*outcomes, F.bool_or(~F.col("recalled")).alias("missed"))
    per_column = (
        per_run.join(runs.select("run_id", "dataset"), "run_id")
        .groupBy("dataset", "defect", "column_name")
        .agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.bool_or("missed").alias("missed"))
    )
    return (
        per_column.groupBy("dataset", "defect")
        .agg(
            F.sum("n").alias("planted_count"),
            F.sum("hits").alias("detected_count"),
            F.sort_array(F.collect_list(F.when(F.col("missed"), F.col("column_name")))).alias("missed_columns"),
        )
        .withColumn("detection_rate", ratio(F.col("detected_count"), F.col("planted_count")))
    )


def per_run_decision(enriched: DataFrame, runs: DataFrame) -> DataFrame:
    """Best score per dataset, decision and run at temperature zero."""
    best = (
        enriched.where("decision_key is not null and layer2_score is not null")
        .groupBy("run_id", "decision_key")
        .agg(F.max("layer2_score").alias("layer2_score"))
    )
    cold = runs.where("temperature = 0.0").select("run_id", "dataset")
    return best.join(cold, "run_id").select("dataset", "decision_key", "run_id", "layer2_score")


def decision_consistency(per_run: DataFrame) -> DataFrame:
    """Spread of a decision's score over the runs that took it, for decisions of two or more runs.

    The score list is kept as a histogram; the score of each run is a row of ``per_run_decision``.
    """
    s = F.col("layer2_score")
    grouped = per_run.groupBy("dataset", "decision_key").agg(
        F.count("*").alias("run_count"),
        *[count_where(s == v).alias(f"score_{v}_count") for v in SCORES],
        F.min(s).alias("min_layer2_score"),
        F.max(s).alias("max_layer2_score"),
    )
    return grouped.where("run_count >= 2").withColumn("score_spread", F.col("max_layer2_score") - F.col("min_layer2_score"))


def base_rates(evidence_refs: DataFrame, runs: DataFrame, dataset: str) -> DataFrame:
    """Largest cited mean of the target per run of one dataset; text that is no number is skipped."""
    target_mean = F.concat(F.lit("col:"), F.col("target_column"), F.lit(":mean"))
    value = F.col("claimed_value_json").try_cast("double")
    means = evidence_refs.where(F.col("metric_key").like("col:%:mean"))
    cited = means.groupBy("run_id", "metric_key").agg(F.max(value).alias("base_rate"))
    wanted = runs.where(F.col("dataset") == dataset).select("run_id", target_mean.alias("metric_key"))
    return cited.join(wanted, ["run_id", "metric_key"]).select("run_id", "base_rate")


def model_metrics(
    run_metrics: DataFrame, evaluations: DataFrame, evidence_refs: DataFrame, runs: DataFrame, base_rate_dataset: str
) -> DataFrame:
    """The selected model of each run with its evaluated value, else the value the run reported."""
    selected = run_metrics.where("reported_arm <> 'B' and best_model_id is not null").select(
        "run_id", "best_model_id", "best_primary_metric_value"
    )
    measured = evaluations.select(
        "run_id", F.col("model_id").alias("best_model_id"), "primary_metric", "primary_metric_mean"
    )
    run_columns = runs.select("run_id", "dataset", "arm", "temperature", "repeat")
    return (
        selected.join(run_columns, "run_id")
        .join(measured, ["run_id", "best_model_id"], "left")
        .join(base_rates(evidence_refs, runs, base_rate_dataset), "run_id", "left")
        .select(
            "run_id",
            "dataset",
            "arm",
            "temperature",
            "repeat",
            F.col("best_model_id").alias("selected_model"),
            "primary_metric",
            F.coalesce("primary_metric_mean", "best_primary_metric_value").alias("primary_metric_value"),
            F.col("base_rate").alias("positive_class_base_rate"),
        )
    )


def detection_totals(gold_detection: DataFrame) -> DataFrame:
    """Detection rows with the grand totals beside them, ordered for the report.

    The gold table has one row per dataset and kind of defect, so the whole-table window is small.
    """
    everything = Window.partitionBy()
    return gold_detection.withColumns(
        {
            "all_detected": F.sum("detected_count").over(everything),
            "all_planted": F.sum("planted_count").over(everything),
        }
    ).orderBy("dataset", "defect")


def coverage_totals(gold_scores: DataFrame) -> DataFrame:
    return gold_scores.agg(
        F.sum("layer1_eligible_count").alias("layer1_eligible_claims"),
        F.sum("layer2_claim_count").alias("layer2_verdicts"),
        F.sum("eligible_missing_layer2_count").alias("eligible_without_layer2"),
        F.sum("ineligible_with_layer2_count").alias("ineligible_with_layer2"),
        F.sum("evidence_misstated_excluded_count").alias("evidence_misstated_excluded"),
    )


def expected_scores(
    enriched: DataFrame, runs: DataFrame, dataset: str, arm: str, decision_key: str, expected: Sequence[int]
) -> DataFrame:
    """Scores of one decision over the runs of one dataset against an expected list."""
    s = F.col("layer2_score")
    wanted = runs.where((F.col("dataset") == dataset) & (F.col("arm") == arm)).select("run_id", "dataset")
    rows = enriched.where(F.col("decision_key") == decision_key).select("run_id", "decision_key", s)
    grouped = (
        rows.join(wanted, "run_id")
        .groupBy("dataset", "decision_key")
        .agg(
            F.count("*").alias("run_count"),
            *[count_where(s == v).alias(f"score_{v}_count") for v in SCORES],
            F.count(s).alias("_scored"),
        )
    )
    same = F.col("_scored") == len(expected)
    for v in SCORES:
        same = same & (F.col(f"score_{v}_count") == list(expected).count(v))
    return grouped.withColumn("matches_expected", same).drop("_scored")


def base_rate_lift(gold_model_metrics: DataFrame, dataset: str) -> DataFrame:
    lift = F.col("primary_metric_value") - F.col("positive_class_base_rate")
    return (
        gold_model_metrics.where(F.col("dataset") == dataset)
        .select(
            "run_id",
            "selected_model",
            "primary_metric",
            "primary_metric_value",
            "positive_class_base_rate",
            lift.alias("absolute_lift"),
        )
        .orderBy("run_id")
    )


def weighted_mean_scores(gold_scores: DataFrame, by: Sequence[str] = ("stage", "temperature")) -> DataFrame:
    """Means weighted by the claims behind them; groups without scores add nothing."""
    n = F.col("layer2_claim_count")
    return (
        gold_scores.groupBy(*by)
        .agg(
            F.sum(n).alias("scored_claims"),
            F.try_divide(F.sum(F.col("mean_layer2_score") * n), F.sum(n)).alias("mean_layer2_score"),
            *[F.sum(f"score_{v}_count").alias(f"score_{v}_count") for v in SCORES],
        )
        .orderBy(*by)
    )
