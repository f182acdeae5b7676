import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.plans import preprocessing as prep
from plumbline.profile import associations as assoc
from plumbline.profile import dataset as ds
from plumbline.profile import univariate as uni
from plumbline.profile.columns import classify, normalize


def wide(frame, target):
    return {r["column_name"]: r for r in ds.with_flags(ds.column_statistics(frame, target)).collect()}


@pytest.fixture(scope="module")
def survey(spark):
    """Twenty rows with one defect per column."""
    rng = np.random.default_rng(11)
    y = [1 if i in (2, 7, 11, 18) else 0 for i in range(20)]
    age = [None if i in (5, 9, 16) else float(20 + (i * 7) % 41) for i in range(20)]
    income = [35000 + (i % 12) * 500 for i in range(20)]
    income[2], income[11] = 260000, 310000
    rows = [
        (
            500 + i, "only", age[i], income[i], f"city{(i * 5) % 13}",
            None if i in (3, 8, 14) else ("mail", "web", "shop")[i % 3],
            i % 5, 4 if i == 6 else 3, y[i], age[i], y[i] + float(rng.normal(0, 0.01)),
        )
        for i in range(20)
    ]
    schema = (
        "person int, state string, age double, income int, city string, channel string, region int, "
        "score int, target int, age_again double, followup double"
    )
    return spark.createDataFrame(rows, schema)


def test_survey_flags(survey):
    p = wide(survey, "target")
    assert p["person"]["is_id_like"] and p["person"]["is_sequential"]
    assert p["state"]["is_constant"] and p["state"]["top_category_pct"] == 100.0
    assert p["age"]["missing_pct"] == 15.0 and p["age"]["has_moderate_missing"]
    assert p["age"]["duplicate_of"] == "age_again" and p["age_again"]["duplicate_of"] == "age"
    assert p["age"]["missingness_cluster_corr_max"] == pytest.approx(1.0)
    assert p["income"]["is_skewed"] and p["income"]["iqr_outlier_pct"] == 10.0
    assert p["region"]["is_numeric_but_categorical"] and not p["income"]["is_numeric_but_categorical"]
    assert p["followup"]["leakage_suspect"] and p["target"]["leakage_suspect"] is None
    assert p["target"]["corr_with_target"] is None and p["city"]["vif"] is None
    assert p["age_again"]["vif"] is None and p["age"]["vif"] is not None


def test_survey_plan(survey):
    flagged = ds.with_flags(ds.column_statistics(survey, "target"))
    plan = {r["column_name"]: r for r in prep.plan_defaults(flagged).collect()}
    dropped = {c: r["drop_reason"] for c, r in plan.items() if r["action"] == "drop"}
    assert dropped == {
        "person": "is_id_like", "state": "is_constant", "age_again": "is_duplicate_of_other_column", "followup": "leakage_suspect",
    }
    assert plan["age"]["imputation"] == "mean" and plan["income"]["scaling"] == "robust"
    assert plan["city"]["encoding"] == "onehot" and plan["score"]["encoding"] == "ordinal"
    assert plan["region"]["encoding"] == "onehot" and plan["channel"]["imputation"] == "constant"
    assert [plan[c]["claim_id"] for c in ("person", "score", "age_again", "followup")] == ["prep_001", "prep_008", "prep_009", "prep_010"]
    assert plan["person"]["evidence_keys"][:3] == ["col:person:dtype", "col:person:nunique", "col:person:is_id_like"]


def test_numbers_equal_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.lognormal(size=400), "b": rng.normal(size=400), "c": rng.integers(0, 50, 400).astype(float)})
    pdf.loc[rng.random(400) < 0.2, "a"] = np.nan
    pdf.loc[rng.random(400) < 0.1, "c"] = np.nan
    pdf["y"] = pdf["b"] * 0.5 + rng.normal(size=400)
    p = wide(spark.createDataFrame(pdf), "y")
    for c in ("a", "b", "c"):
        s = pdf[c]
        for metric, want in {
            "mean": s.mean(), "std": s.std(), "median": s.median(), "skew": s.skew(), "kurtosis": s.kurt(),
            "min": s.min(), "max": s.max(), "corr_with_target": s.corr(pdf["y"]),
            "missingness_target_corr": s.isna().astype(float).corr(pdf["y"]) if s.isna().any() else None,
            "max_abs_corr_other": pdf.corr()[c].drop(c).abs().max(),
        }.items():
            got = p[c][metric]
            assert got == pytest.approx(want, rel=1e-9) if want is not None else got is None, (c, metric)
    filled = pdf[["a", "b", "c"]].fillna(pdf[["a", "b", "c"]].median())
    inverse = np.linalg.inv(filled.corr().to_numpy())
    assert [p[c]["vif"] for c in ("a", "b", "c")] == pytest.approx(list(np.diag(inverse)), rel=1e-9)


def test_empty_single_and_constant_frames(spark):
    schema = "x double, s string, y int"
    empty = wide(spark.createDataFrame([], schema), "y")
    assert empty["x"]["mean"] is None and empty["x"]["missing_pct"] is None and empty["x"]["is_constant"]
    one = wide(spark.createDataFrame([(1.5, "a", 0)], schema), "y")
    assert one["x"]["std"] is None and one["x"]["skew"] is None and one["s"]["corr_with_target"] is None
    same = wide(spark.createDataFrame([(0.1, "a", i % 2) for i in range(9)], schema), "y")
    assert same["x"]["skew"] == 0.0 and same["x"]["kurtosis"] == 0.0 and same["x"]["corr_with_target"] is None
    assert same["x"]["iqr_outlier_pct"] == 0.0 and same["x"]["vif"] is None
    gone = wide(spark.createDataFrame([(None, None, i % 2) for i in range(9)], schema), "y")
    assert gone["x"]["missing_pct"] == 100.0 and gone["x"]["has_high_missing"] and gone["x"]["nunique"] == 0


def test_nan_counts_as_missing_and_infinity_is_no_result(spark):
    frame = spark.createDataFrame([(float("nan"), 1.0, 0), (1.0, float("inf"), 1), (2.0, 3.0, 0), (4.0, 5.0, 1)], "a double, b double, y int")
    p = wide(frame, "y")
    assert p["a"]["missing_pct"] == 25.0 and p["a"]["mean"] == pytest.approx(7 / 3)
    assert p["b"]["mean"] is None and p["b"]["max"] is None and p["b"]["min"] == 1.0


def test_zero_inflation_is_strict(spark):
    half = wide(spark.createDataFrame([(0, 1), (0, 0), (5, 1), (9, 0)], "x int, y int"), "y")
    assert not half["x"]["is_zero_inflated"] and half["x"]["nonzero_pct"] == 50.0
    most = wide(spark.createDataFrame([(0, 1)] * 9 + [(5, 0)], "x int, y int"), "y")
    assert most["x"]["is_zero_inflated"] and most["x"]["iqr_outlier_pct"] is None


def test_missing_thresholds_use_the_rounded_share(spark):
    n = 20_000
    frame = spark.range(n).select(
        F.when(F.col("id") >= 1, 1.0 * F.col("id")).alias("one"),
        F.when(F.col("id") >= n * 0.05, 1.0 * F.col("id")).alias("five"),
        F.when(F.col("id") >= n * 0.4, 1.0 * F.col("id")).alias("forty"),
        F.when(F.col("id") >= n * 0.4 + 2, 1.0 * F.col("id")).alias("over"),
        (F.col("id") % 2).alias("y"),
    )
    p = wide(frame, "y")
    assert p["one"]["missing_pct"] == 0.01 and p["one"]["has_missing"]
    assert not p["five"]["has_moderate_missing"]
    assert p["forty"]["has_moderate_missing"] and not p["forty"]["has_high_missing"]
    assert p["over"]["has_high_missing"]


def test_boolean_column_is_categorical(spark):
    frame = spark.createDataFrame([(True, 1.0, 0), (True, None, 1), (True, 2.0, 0), (False, 3.0, 1)], "b boolean, x double, y int")
    p = wide(frame, "y")
    assert p["b"]["kind"] == "categorical" and p["b"]["top_category_pct"] == 75.0
    assert p["b"]["mean"] is None and p["b"]["iqr_outlier_pct"] is None and p["b"]["vif"] is None


@pytest.mark.parametrize(
    "counts, flag",
    [({"a": 16, "b": 4}, False), ({"a": 17, "b": 4}, True), ({"a": 95, "b": 50, "c": 5}, True), ({"a": 50, "b": 45, "c": 5}, False), ({"a": 3}, False), ({}, None)],
)
def test_imbalance_is_strict(spark, counts, flag):
    data = [(k,) for k, n in counts.items() for _ in range(n)] + [(None,)]
    frame = spark.createDataFrame(data, "t string")
    assert assoc.is_imbalanced(assoc.class_counts(frame, "t")).first()[0] is flag


def test_sequences(spark):
    frame = spark.createDataFrame(
        [(i * 3, float(i), i * 0.5, i * i, 7, -(2**62) * (1 if i else -1)) for i in range(5)],
        "step int, whole double, half double, square int, same int, far bigint",
    )
    got = {r["column_name"]: r["is_sequential"] for r in uni.sequential(uni.value_frequencies(frame, classify(frame))).collect()}
    assert got == {"step": True, "whole": True, "half": False, "square": False, "same": False, "far": False}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 20, 101])
def test_quantiles_of_few_rows(spark, n):
    frame = spark.range(n).select((F.col("id") * F.col("id") % 17).cast("double").alias("v"), F.lit(float("inf")).alias("w"))
    probs = (0.0, 0.25, 0.5, 0.75, 1.0)
    got = {(r[0], r[1]): r[2] for r in uni.exact_quantiles(uni.numeric_values(frame, classify(frame)), probs).collect()}
    want = frame.toPandas()["v"]
    assert [got["v", p] for p in probs] == pytest.approx([want.quantile(p) for p in probs])
    assert [got["w", p] for p in probs] == [float("inf")] * 5


def test_bracket_quantiles_are_exact(spark):
    frame = spark.range(60_000).select(
        F.exp(F.sin(F.col("id") * 1.7) * 5).alias("wild"), (F.col("id") % 3 * (F.col("id") % 1000 == 0).cast("int")).cast("double").alias("tied")
    )
    values = uni.numeric_values(frame, classify(frame))
    probs = (0.01, 0.25, 0.5, 0.75, 0.999)
    whole = frame.toPandas()
    exact = {(c, p): whole[c].quantile(p) for c in whole for p in probs}
    bracket = {(r[0], r[1]): r[2] for r in uni.exact_quantiles(values, probs).collect()}
    assert bracket.keys() == exact.keys() and len(exact) == 10
    for key, value in exact.items():
        assert bracket[key] == pytest.approx(value, rel=1e-12)


def test_block_correlations_equal_expressions(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame(rng.normal(1e6, 3.0, size=(500, 6)), columns=list("abcdef"))
    pdf["b"] = pdf["a"] + rng.normal(size=500) * 0.01
    pdf["f"] = 2.5
    pdf[rng.random(pdf.shape) < 0.2] = np.nan
    frame = normalize(spark.createDataFrame(pdf))
    names = list(pdf.columns)
    plain = {(r[0], r[1]): r[2] for r in assoc.pair_correlations(frame, names).collect()}
    block = {(r[0], r[1]): r[2] for r in assoc.pair_correlations(frame.repartition(5), names, uni.means(frame, names)).collect()}
    want = pdf.corr()
    for pair, r in plain.items():
        truth = want.loc[pair[0], pair[1]]
        if math.isnan(truth):
            assert r is None and block[pair] is None
        else:
            assert r == pytest.approx(truth, abs=1e-9) and block[pair] == pytest.approx(truth, abs=1e-9)


def test_near_duplicates_and_first_match(spark):
    n = 500
    frame = spark.range(n).select(
        F.col("id").cast("double").alias("a"),
        (F.col("id") + F.sin(F.col("id")) * 0.01).alias("b"),
        (F.col("id") * 2.0).alias("doubled"),
        F.col("id").cast("double").alias("c"),
        F.col("id").cast("int").alias("same_value_other_type"),
        (F.col("id") % 2).alias("y"),
    )
    p = wide(frame, "y")
    assert p["a"]["duplicate_of"] == "b" and p["b"]["duplicate_of"] == "a" and p["c"]["duplicate_of"] == "a"
    assert p["doubled"]["duplicate_of"] is None
    flagged = ds.with_flags(ds.column_statistics(frame, "y"))
    kept = {r["column_name"] for r in prep.mark_redundant(flagged).where("not is_redundant").collect()}
    assert "a" in kept and not {"b", "c"} & kept


def test_exact_collinearity_has_no_vif():
    r = np.array([[1.0, 1.0, 0.2], [1.0, 1.0, 0.2], [0.2, 0.2, 1.0]])
    first, second, third = assoc.variance_inflation(r)
    assert first is None and second is None and third == pytest.approx(1 / (1 - 0.04))


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_profile_does_not_depend_on_partitioning(spark, survey, parts):
    base = {r["metric_key"]: (r["bool_value"], r["str_value"]) for r in ds.profile(survey, "target", "binary").collect()}
    got = {r["metric_key"]: (r["bool_value"], r["str_value"]) for r in ds.profile(survey.repartition(parts), "target", "binary").collect()}
    assert got == base


def test_dataset_metrics(spark):
    frame = spark.createDataFrame([("a", 1)] * 3 + [("b", 1), (None, 2)], "t string, x int")
    got = {r["metric_key"]: r for r in ds.dataset_metrics(frame, "t", "binary").collect()}
    assert got["n_rows"]["num_value"] == 5 and got["n_duplicated_rows"]["num_value"] == 2
    assert got["target_class_balance"]["map_value"] == {"a": 0.6, "b": 0.2, "nan": 0.2}
    assert got["target_skew"]["num_value"] is None
    numbers = {r["metric_key"]: r for r in ds.dataset_metrics(frame, "x", "regression").collect()}
    assert numbers["target_skew"]["num_value"] == pytest.approx(pd.Series([1, 1, 1, 1, 2]).skew())
    assert numbers["target:is_imbalanced"]["bool_value"] is None
    with pytest.raises(ValueError):
        ds.profile(frame, "t", "clustering")
    with pytest.raises(ValueError):
        ds.column_statistics(frame, "absent")


def test_planted_defects_are_identified(spark, rows):
    from plumbline.operators import corruption as cor

    frame = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("y"))
    long = ds.profile(cor.plant_defects(frame, "y", "id"), "y", "regression")
    found = ds.planted_defects(long, cor.COLUMNS)
    assert rows(found, "defect", "column_name", "unambiguous") == [
        ("constant", cor.CONSTANT, True), ("high_missing", cor.HIGH_MISSING, True), ("leakage", cor.LEAKED, True),
    ]


def test_save_profiles_replaces_only_its_dataset(spark, tmp_path):
    frame = spark.createDataFrame([(1, 0), (2, 1)], "x int, y int")
    path = str(tmp_path / "profiles")
    ds.save_profiles({"one": (frame, "y", "binary"), "two": (frame, "y", "binary")}, path)
    first = spark.read.parquet(path).groupBy("entity").count().collect()
    ds.save_profiles({"one": (frame, "y", "binary")}, path)
    assert spark.read.parquet(path).groupBy("entity").count().collect() == first and len(first) == 2


def test_override_cap_and_drop_refusal(spark, rows):
    plans = spark.createDataFrame(
        [("r", f"c{i}", i, "drop" if i == 0 else "scale", "none", "none", "none" if i == 0 else "standard") for i in range(6)],
        "run_id string, column_name string, ordinal int, action string, imputation string, encoding string, scaling string",
    )
    proposals = spark.createDataFrame(
        [("r", f"c{i}", "none", "none", "standard" if i == 2 else "robust", "why") for i in range(6)],
        "run_id string, column_name string, imputation string, encoding string, scaling string, override_reason string",
    )
    got = prep.apply_overrides(plans, proposals)
    assert rows(got, "column_name", "is_override", "log") == [
        ("c0", False, "DROP_OVERRIDE_REJECTED:c0"), ("c1", True, None), ("c2", False, None), ("c3", True, None),
        ("c4", True, None), ("c5", False, "OVERRIDE_CAP_REACHED:c5"),
    ]
    assert prep.override_summary(got).first()["override_rate"] == pytest.approx(0.5)


def test_duplicate_groups_are_connected():
    groups = prep.duplicate_groups([("a", "b"), ("c", "d"), ("b", "c"), ("x", "y")])
    assert sorted(sorted(g) for g in groups) == [["a", "b", "c", "d"], ["x", "y"]]


def test_duplicate_rows_when_digests_collide(spark):
    rows = [(1, "a", 0.0), (1, "a", -0.0), (None, "a", 1.0), (None, "a", 1.0), (2, None, float("nan")), (2, None, float("nan")), (3, "b", 2.0)]
    rows += [(9, "again", 1.0)] * 50
    frame = spark.createDataFrame(rows, "k int, s string, v double").repartition(4)
    want = (5, 57, 52)
    assert tuple(ds.duplicate_rows(frame).first()) == want
    few = lambda df: ds.digested(df).withColumn("_a", F.lit(1).cast("bigint")).withColumn("_b", F.pmod("_b", F.lit(2)))
    assert tuple(ds.duplicate_rows(frame, few).first()) == want
    assert tuple(ds.duplicate_rows(frame.limit(0)).first()) == (0, 0, 0)
