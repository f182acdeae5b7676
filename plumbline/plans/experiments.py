"""Analytics across repeated runs: variance, consensus, agreement with an expected plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import ratio

# Patterns over lower-cased critic notes.
RISK = r"risk|overfit|overfitting|high[ -]variance"
CONTRADICTION = r"contradict|inconsisten|despite|yet select|still select|reconcil"
UNSUPPORTED = r"unsupported|not supported|not evidenced|invent"
NARRATIVE = r"business|domain|outcome|narrative|real-world|context"

# Expectations that accept either of two transforms.
FLEXIBLE = {
    "standard_or_robust_by_skew": ("standard", "robust"),
    "onehot_or_ordinal_by_cardinality": ("onehot", "ordinal"),
}

# Runs per dataset as (arm, temperature, repeat).
MATRIX = (("ab", 0.0, 1), ("ab", 0.0, 2), ("ab", 0.0, 3), ("ab", 0.7, 1), ("c", 0.0, 1))

NOTABLE_DELTA = 0.25
CALL_BASE, CALL_PER_COLUMN, BATCH = 28, 1.12, 15


def selects_despite_risk(note: Column) -> Column:
    text = F.lower(note)
    return text.rlike(RISK) & text.rlike(CONTRADICTION)


def invents_narrative(note: Column) -> Column:
    text = F.lower(note)
    return text.rlike(UNSUPPORTED) & text.rlike(NARRATIVE)


def pattern_counts(claims: DataFrame, verdicts: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Notes of two kinds per group, each counted in the stage it concerns."""
    joined = verdicts.join(claims.select(*keys, "stage"), list(keys))
    note = F.coalesce(F.col("discrepancy_note"), F.lit(""))
    risk = (F.col("stage") == "model_selection") & selects_despite_risk(note)
    story = (F.col("stage") == "evaluation") & invents_narrative(note)
    return joined.groupBy(*by).agg(
        F.count_if(risk).alias("select_despite_risk_count"), F.count_if(story).alias("invented_narrative_count")
    )


def run_stage_means(scores: DataFrame) -> DataFrame:
    """Mean score per run and stage."""
    return scores.groupBy("dataset", "run_id", "temperature", "stage").agg(F.avg("layer2_score").alias("run_mean"))


def stage_mean_std(run_means: DataFrame) -> DataFrame:
    """Mean and population deviation of the run means over the repeats at temperature zero."""
    return (
        run_means.where("temperature = 0.0")
        .groupBy("dataset", "stage")
        .agg(
            F.count("run_mean").alias("runs"),
            F.avg("run_mean").alias("mean_layer2_score"),
            F.stddev_pop("run_mean").alias("std_layer2_score"),
        )
    )


def temperature_delta(run_means: DataFrame) -> DataFrame:
    """Stage means of both temperatures and whether they differ notably."""
    cold, warm = F.col("temperature") == 0.0, F.col("temperature") != 0.0
    both = run_means.groupBy("dataset", "stage").agg(
        F.avg(F.when(cold, F.col("run_mean"))).alias("cold_mean"),
        F.avg(F.when(warm, F.col("run_mean"))).alias("warm_mean"),
    )
    delta = F.abs(F.col("warm_mean") - F.col("cold_mean"))
    return both.withColumn("delta", delta).withColumn("notable", F.col("delta") >= NOTABLE_DELTA)


def consensus(decisions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Decisions taken in every run of their group."""
    by = list(by)
    distinct = decisions.select(*by, "stage", "decision", "run_id").distinct()
    runs = distinct.groupBy(*by).agg(F.count_distinct("run_id").alias("_runs"))
    shared = distinct.groupBy(*by, "stage", "decision").agg(F.count("*").alias("_n"))
    return shared.join(runs, by).where("_n = _runs").select(*by, "stage", "decision")


def changed_decisions(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Size of the symmetric difference of two decision sets per group."""
    keys = [*by, "stage", "decision"]
    marks = left.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        right.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    sides = marks.groupBy(*keys).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return sides.groupBy(*by).agg(F.count_if(F.col("a") != F.col("b")).alias("changed_decisions"))


def variance_note(deltas: DataFrame, changes: DataFrame) -> DataFrame:
    """One sentence per dataset from the numbers above; stage names are few per dataset."""
    notable = F.sort_array(F.collect_set(F.when(F.col("notable"), F.col("stage"))))
    per_dataset = deltas.groupBy("dataset").agg(notable.alias("notable_stages"), F.count("delta").alias("_compared"))
    joined = per_dataset.join(changes, "dataset", "left").fillna(0, ["changed_decisions"])
    text = (
        F.when(F.col("_compared") == 0, "Variance comparison unavailable until both temperature conditions are complete.")
        .when(
            (F.size("notable_stages") > 0) | (F.col("changed_decisions") > 0),
            F.format_string(
                "Notable variance: score delta >=0.25 in [%s]; %d consensus decision entries differed.",
                F.array_join("notable_stages", ", "),
                F.col("changed_decisions"),
            ),
        )
        .otherwise("No notable variance in stage means or consensus decisions at temperature 0.7.")
    )
    return joined.select("dataset", text.alias("temp07_variance_note"))


def planned_runs(datasets: DataFrame) -> DataFrame:
    """The run matrix: every dataset with the five (arm, temperature, repeat) settings."""
    settings = F.array(
        *[
            F.struct(F.lit(a).alias("arm"), F.lit(t).alias("temperature"), F.lit(r).cast("bigint").alias("repeat"))
            for a, t, r in MATRIX
        ]
    )
    runs = datasets.select("dataset", F.inline(settings))
    code = F.when(F.col("temperature") == 0.0, "t00").otherwise("t07")
    return runs.withColumn(
        "run_id", F.concat(F.lit("m9_"), "dataset", F.lit("_"), "arm", F.lit("_"), code, F.lit("_r"), "repeat")
    )


def call_budget(columns: Column) -> tuple[Column, Column, Column]:
    """Expected call range for a feature count, and the cap per run."""
    batches = F.ceil(columns / BATCH)
    return columns + 13 + batches, columns + 20 + batches, F.floor(F.lit(CALL_BASE) + columns * CALL_PER_COLUMN)


def expected_matches(expected: Column, actual: Column) -> Column:
    """Equality, or membership where the expectation allows a choice."""
    result = expected == actual
    for name, allowed in FLEXIBLE.items():
        result = F.when(expected == name, actual.isin(*allowed)).otherwise(result)
    return F.coalesce(result, F.lit(False))


def compare_plans(
    expected: DataFrame, actual: DataFrame, keys: Sequence[str], fields: Sequence[str] = ("action", "imputation", "encoding", "scaling")
) -> DataFrame:
    """Field-by-field match of expected plan rows; a field without expectation is not scored."""
    renamed = actual.select(*keys, F.lit(True).alias("_planned"), *[F.col(f).alias(f"actual_{f}") for f in fields])
    joined = expected.join(renamed, list(keys), "left")
    every = F.col("_planned").isNotNull()
    for f in fields:
        match = F.when(F.col(f).isNotNull(), expected_matches(F.col(f), F.col(f"actual_{f}")))
        joined = joined.withColumn(f"{f}_matches", match)
        every = every & F.coalesce(match, F.lit(True))
    return joined.withColumn("matches", every).drop("_planned")


def plan_agreement(compared: DataFrame, by: Sequence[str]) -> DataFrame:
    """Agreement rate per run with the columns dropped or kept against expectation."""
    expected_drop, actual_drop = F.col("action") == "drop", F.col("actual_action") == "drop"
    kept = F.coalesce(expected_drop & ~F.coalesce(actual_drop, F.lit(False)), F.lit(False))
    dropped = F.coalesce(~F.coalesce(expected_drop, F.lit(False)) & actual_drop, F.lit(False))
    hits = F.count_if(F.col("matches"))
    return compared.groupBy(*by).agg(
        hits.alias("column_plan_matches"),
        F.count("*").alias("column_plans_scored"),
        ratio(hits, F.count("*")).alias("column_plan_agreement_rate"),
        F.count_if(kept).alias("expected_drop_but_kept"),
        F.count_if(dropped).alias("expected_keep_but_dropped"),
    )


def unscored_columns(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    return actual.select(*keys).distinct().join(expected.select(*keys), list(keys), "left_anti")


def agreement_rollup(comparisons: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean agreement and the share of runs whose choices match, over the runs of a group."""
    flags = ("top_model_match", "ranking_exact_match", "rejected_model_match", "metric_match")
    return comparisons.groupBy(*by).agg(
        F.count("*").alias("temp0_runs_compared"),
        F.avg("column_plan_agreement_rate").alias("column_plan_agreement_rate"),
        *[F.avg(F.coalesce(F.col(f), F.lit(False)).cast("double")).alias(f"{f}_rate") for f in flags],
    )


def consistent_recall(defects: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Defects recalled in every run, against the number planted."""
    per_defect = defects.groupBy(*by, "defect").agg(F.bool_and(F.coalesce("recalled", F.lit(False))).alias("always"))
    return per_defect.groupBy(*by).agg(
        F.count_if(F.col("always")).alias("recalled_defects"), F.count("*").alias("planted_defects")
    )


def overall_recall(recall: DataFrame) -> DataFrame:
    """Recall over all datasets; the denominator is what was planted."""
    return recall.agg(
        F.sum("recalled_defects").alias("recalled"),
        F.sum("planted_defects").alias("planted"),
        ratio(F.sum("recalled_defects"), F.sum("planted_defects")).alias("overall_recall_rate"),
    )


def lowest_stage_count(stage_means: DataFrame, stage: str) -> DataFrame:
    """In how many datasets one stage scores strictly below all others."""
    own = F.max(F.when(F.col("stage") == stage, F.col("mean_layer2_score")))
    others = F.min(F.when(F.col("stage") != stage, F.col("mean_layer2_score")))
    per_dataset = stage_means.groupBy("dataset").agg(own.alias("own"), others.alias("others"))
    return per_dataset.agg(
        F.count_if(F.col("own") < F.col("others")).alias("lowest_in"), F.count("*").alias("datasets")
    )


def apply_aliases(plans: DataFrame, aliases: dict[str, str], column: str = "column_name") -> DataFrame:
    """Expected names replaced by the names the dataset uses."""
    if not aliases:
        return plans
    mapping = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return plans.withColumn(column, F.coalesce(mapping[F.col(column)], F.col(column)))
