import pytest
from pyspark.sql import functions as F

from plumbline.plans import experiments as ex


def test_matrix_has_five_runs_per_dataset(spark):
    datasets = spark.createDataFrame([(d,) for d in ("adult", "ames", "credit", "ship", "wine")], "dataset string")
    runs = ex.planned_runs(datasets).collect()
    assert len(runs) == 25 and len({r["run_id"] for r in runs}) == 25
    assert sum(r["arm"] == "ab" for r in runs) == 20
    assert "m9_wine_ab_t07_r1" in {r["run_id"] for r in runs}


@pytest.mark.parametrize("columns, low, high, cap", [(121, 143, 150, 163), (15, 29, 36, 44), (16, 31, 38, 45)])
def test_call_budget(spark, columns, low, high, cap):
    got = spark.range(1).select(*ex.call_budget(F.lit(columns))).first()
    assert [int(v) for v in got] == [low, high, cap]


@pytest.mark.parametrize(
    "note, risk, story",
    [
        ("Overfitting risk is noted, YET SELECTS it", True, False),
        ("high-variance model", False, False),
        ("inconsistent with the risk", True, False),
        ("unsupported business outcome", False, True),
        ("invented", False, False),
    ],
)
def test_note_patterns(spark, note, risk, story):
    row = spark.createDataFrame([(note,)], "n string").select(
        ex.selects_despite_risk(F.col("n")), ex.invents_narrative(F.col("n"))
    ).first()
    assert tuple(row) == (risk, story)


def test_cross_run_summary(spark):
    scores = [("d", f"r{r}", 0.0, "eda", s) for r in range(3) for s in (1, 2)] + [("d", "w", 0.7, "eda", 2)]
    frame = spark.createDataFrame(scores, "dataset string, run_id string, temperature double, stage string, layer2_score int")
    means = ex.run_stage_means(frame)
    row = ex.stage_mean_std(means).first()
    assert (row["runs"], row["mean_layer2_score"], row["std_layer2_score"]) == (3, 1.5, 0.0)
    delta = ex.temperature_delta(means).first()
    assert delta["delta"] == 0.5 and delta["notable"]
    changes = spark.createDataFrame([("d", 2)], "dataset string, changed_decisions bigint")
    note = ex.variance_note(ex.temperature_delta(means), changes).first()["temp07_variance_note"]
    assert note == "Notable variance: score delta >=0.25 in [eda]; 2 consensus decision entries differed."


def test_consensus_and_difference(spark, rows):
    taken = [("d", "eda", "x", "r1"), ("d", "eda", "x", "r2"), ("d", "eda", "y", "r1"), ("d", "eda", "x", "r1")]
    frame = spark.createDataFrame(taken, "dataset string, stage string, decision string, run_id string")
    shared = ex.consensus(frame, ["dataset"])
    assert rows(shared) == [("d", "eda", "x")]
    other = spark.createDataFrame([("d", "eda", "z")], "dataset string, stage string, decision string")
    assert rows(ex.changed_decisions(shared, other, ["dataset"])) == [("d", 2)]


def test_plan_comparison_accepts_flexible_expectations(spark, rows):
    schema = "run_id string, column_name string, action string, imputation string, encoding string, scaling string"
    expected = spark.createDataFrame(
        [
            ("r", "a", "scale", None, "none", "standard_or_robust_by_skew"),
            ("r", "b", "drop", None, None, None),
            ("r", "c", "encode", "none", "onehot_or_ordinal_by_cardinality", None),
            ("r", "gone", "drop", None, None, None),
            ("r", "d", "scale", None, None, None),
        ],
        schema,
    )
    actual = spark.createDataFrame(
        [
            ("r", "a", "scale", "mean", "none", "robust"),
            ("r", "b", "scale", "none", "none", "standard"),
            ("r", "c", "encode", "none", "target", "none"),
            ("r", "d", "drop", "none", "none", "none"),
            ("r", "extra", "drop", "none", "none", "none"),
        ],
        schema,
    )
    compared = ex.compare_plans(expected, actual, ["run_id", "column_name"])
    assert rows(compared, "column_name", "matches") == [("a", True), ("b", False), ("c", False), ("d", False), ("gone", False)]
    summary = ex.plan_agreement(compared, ["run_id"]).first()
    assert summary["column_plan_agreement_rate"] == pytest.approx(0.2)
    assert (summary["expected_drop_but_kept"], summary["expected_keep_but_dropped"]) == (2, 1)
    assert rows(ex.unscored_columns(expected, actual, ["run_id", "column_name"])) == [("r", "extra")]


def test_recall_over_repeats(spark):
    data = [("d", "a", True), ("d", "a", True), ("d", "b", True), ("d", "b", False), ("e", "a", None)]
    recall = ex.consistent_recall(spark.createDataFrame(data, "dataset string, defect string, recalled boolean"))
    assert {r["dataset"]: (r["recalled_defects"], r["planted_defects"]) for r in recall.collect()} == {"d": (1, 2), "e": (0, 1)}
    assert ex.overall_recall(recall).first()["overall_recall_rate"] == pytest.approx(1 / 3)


def test_lowest_stage_is_strict(spark):
    data = [("d", "m", 1.0), ("d", "e", 2.0), ("e", "m", 2.0), ("e", "e", 2.0), ("f", "e", 1.0)]
    frame = spark.createDataFrame(data, "dataset string, stage string, mean_layer2_score double")
    assert tuple(ex.lowest_stage_count(frame, "m").first()) == (1, 3)


def test_aliases(spark):
    frame = spark.createDataFrame([("fixed_acidity",), ("pH",)], "column_name string")
    got = {r[0] for r in ex.apply_aliases(frame, {"fixed_acidity": "fixed acidity"}).collect()}
    assert got == {"fixed acidity", "pH"}
