import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.hashing import fold
from plumbline.operators import corruption as cor
from plumbline.operators import evaluation as ev
from plumbline.operators import features as ft


def encoder_frame(spark, n=400):
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 13 == 0, None).when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("c"), (F.col("id") % 20).cast("string"))
        ).alias("cat"),
        ((F.col("id") * 7) % 5 == 0).cast("int").alias("y"),
        fold(F.col("id"), 5).alias("f"),
    )


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_out_of_fold_encoding_equals_brute_force(spark, parts):
    frame = encoder_frame(spark).repartition(parts)
    got = {r["id"]: r["e"] for r in ft.out_of_fold_encoding(frame, "cat", "y", "f", "e").collect()}
    data = frame.collect()
    for row in data:
        rest = [r for r in data if r["f"] != row["f"]]
        prior = np.mean([r["y"] for r in rest])
        same = [r["y"] for r in rest if r["cat"] == row["cat"] and row["cat"] is not None]
        w = len(same) / (len(same) + 10.0)
        want = prior * (1 - w) + (np.mean(same) if same else 0.0) * w
        assert got[row["id"]] == pytest.approx(want, abs=1e-12)


def test_out_of_fold_priors_differ_between_folds(spark):
    frame = encoder_frame(spark).withColumn("cat", F.lit(None).cast("string"))
    priors = ft.out_of_fold_encoding(frame, "cat", "y", "f", "e").select("f", "e").distinct().collect()
    assert len(priors) == 5 and len({round(r["e"], 12) for r in priors}) > 1


def test_out_of_fold_needs_two_rows(spark):
    with pytest.raises(ValueError, match="two rows"):
        ft.out_of_fold_encoding(encoder_frame(spark, 1), "cat", "y", "f", "e")


def test_unseen_category_gets_the_prior(spark):
    fit = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "c string, y int")
    stats, prior = ft.target_encoding(fit, "c", "y")
    new = spark.createDataFrame([("z",), (None,), ("b",)], "c string")
    got = {r["c"]: r["e"] for r in ft.apply_target_encoding(new, stats, "c", prior, "e").collect()}
    p = 2 / 3
    assert got["z"] == got[None] == pytest.approx(p)
    assert got["b"] == pytest.approx(p * (1 - 1 / 11) + 1 / 11)


def test_mode_takes_the_smallest_on_ties(spark):
    frame = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert ft.fit_modes(frame, ["c"]) == {"c": "a"}


def test_scalers(spark):
    values = [1.0, 2.0, 4.0, 9.0]
    frame = spark.createDataFrame([(v, 5.0) for v in values], "x double, k double")
    stats = ft.fit_numeric(frame, ["x", "k"])
    x = np.array(values)
    q1, q2, q3 = np.percentile(x, [25, 50, 75])
    want = {
        "standard": (x - x.mean()) / x.std(),
        "minmax": (x - 1) / 8,
        "robust": (x - q2) / (q3 - q1),
    }
    for method, expected in want.items():
        got = [r[0] for r in frame.select(ft.scale(F.col("x"), method, stats["x"])).collect()]
        assert np.allclose(sorted(got), expected)
        assert {r[0] for r in frame.select(ft.scale(F.col("k"), method, stats["k"])).collect()} == {0.0}


def test_indicator_only_for_columns_with_gaps_in_the_fit_rows(spark):
    fit = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 3.0)], "id int, a double, b double")
    specs = [ft.ColumnSpec("a", "constant", add_indicator=True), ft.ColumnSpec("b", "constant", add_indicator=True)]
    made = ft.transform(fit, fit, specs, ["id"])
    assert made.columns == ["id", "a", "b_missing", "b"]
    assert {tuple(r) for r in made.collect()} == {(1, 1.0, 1, -999.0), (2, 2.0, 0, 3.0)}


def test_statistics_come_from_fit_rows_only(spark):
    fit = spark.createDataFrame([(0.0,), (2.0,), (None,)], "x double")
    new = spark.createDataFrame([(None,), (100.0,)], "x double")
    spec = [ft.ColumnSpec("x", "mean", scaling="standard")]
    got = sorted(r[0] for r in ft.transform(fit, new, spec, []).collect())
    std = np.std([0.0, 2.0, 1.0])
    assert got == pytest.approx([0.0, 99.0 / std])


def scored(spark, n=600):
    return spark.range(n).select(
        F.lit("m").alias("model_id"),
        (F.col("id") % 2).alias("fold"),
        ((F.col("id") * 31) % 7 < 3).cast("int").alias("y"),
        F.floor((F.col("id") * 17) % 101 / 9.0).alias("score"),
        ((F.col("id") * 17) % 101 > 50).cast("int").alias("prediction"),
    )


def test_ranking_metrics_equal_brute_force_with_ties(spark):
    data = scored(spark).collect()
    got = {(r["fold"], r["metric"]): r["value"] for r in ev.ranking_metrics(scored(spark)).collect()}
    for f in (0, 1):
        y = np.array([r["y"] for r in data if r["fold"] == f])
        s = np.array([r["score"] for r in data if r["fold"] == f], dtype=float)
        pos, neg = s[y == 1], s[y == 0]
        auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
        assert got[(f, "roc_auc")] == pytest.approx(auc)
        ap, seen = 0.0, 0
        for t in sorted(set(s), reverse=True):
            hits = (y[s >= t]).sum()
            ap += (hits - seen) / len(pos) * hits / (s >= t).sum()
            seen = hits
        assert got[(f, "pr_auc")] == pytest.approx(ap)


def test_single_class_fold_is_not_usable(spark):
    one = scored(spark).withColumn("y", F.lit(1))
    metrics = ev.ranking_metrics(one).withColumn("split", F.lit("validation"))
    assert all(r["value"] is None for r in metrics.collect())
    assert {r["usable_folds"] for r in ev.fold_summary(metrics).collect()} == {0}


def test_zero_division_gives_zero(spark):
    none = spark.createDataFrame([("m", 0, 0, 0)], "model_id string, fold int, y int, prediction int")
    got = {r["metric"]: r["value"] for r in ev.binary_metrics(none).collect()}
    assert got == {"f1": 0.0, "precision": 0.0, "recall": 0.0, "accuracy": 1.0}


def test_class_metrics_equal_independent_computation(spark):
    rng = np.random.default_rng(3)
    y, h = rng.integers(0, 3, 200), rng.integers(0, 4, 200)
    frame = spark.createDataFrame([("m", 0, int(a), int(b)) for a, b in zip(y, h)], "model_id string, fold int, y int, prediction int")
    got = {r["metric"]: r["value"] for r in ev.class_metrics(frame).collect()}
    f1s = []
    for c in range(4):
        tp = ((y == c) & (h == c)).sum()
        f1 = 2 * tp / ((y == c).sum() + (h == c).sum())
        f1s.append(f1)
        assert got[f"per_class_f1:{c}"] == pytest.approx(f1)
    assert got["macro_f1"] == pytest.approx(np.mean(f1s))
    assert got["balanced_accuracy"] == pytest.approx(np.mean([((y == c) & (h == c)).sum() / (y == c).sum() for c in range(3)]))


def test_folds_deal_out_every_class_evenly(spark):
    frame = spark.range(1003).select("id", (F.col("id") % 10 == 0).alias("label"))
    sizes = ev.stratified_folds(frame, "label", "id").groupBy("label", "fold").count().collect()
    for label in (True, False):
        counts = [r["count"] for r in sizes if r["label"] == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_best_model_direction_and_ties(spark):
    rows = [("r", "a", 2, "rmse", 1.0), ("r", "b", 1, "rmse", 1.0), ("r", "c", 3, "rmse", 2.0),
            ("s", "a", 1, "roc_auc", 0.7), ("s", "b", 2, "roc_auc", 0.9)]
    frame = spark.createDataFrame(rows, "run_id string, model_id string, rank int, primary_metric string, primary_metric_mean double")
    got = {r["run_id"]: r["best_model_id"] for r in ev.best_model(frame, ["run_id"]).collect()}
    assert got == {"r": "b", "s": "b"}


@pytest.mark.parametrize("parts", [1, 17])
def test_numeric_leak_has_the_exact_correlation(spark, parts):
    frame = spark.range(1000).select("id", ((F.col("id") % 3) == 0).cast("double").alias("y")).repartition(parts)
    planted = cor.plant_defects(frame, "y", "id")
    report = cor.corruption_report(planted, "y").first()
    assert report["leaked_corr_with_target"] == pytest.approx(0.99, abs=1e-12)
    assert report["constant_nunique"] == 1 and report["high_missing_pct"] == pytest.approx(60.0)


def test_defects_do_not_move_with_partitioning(spark):
    frame = spark.range(500).select("id", F.col("id").cast("double").alias("y"))
    a = {tuple(r) for r in cor.plant_missing(frame, "id").collect()}
    b = {tuple(r) for r in cor.plant_missing(frame.repartition(17), "id").collect()}
    assert a == b


def test_label_leak_flips_half_a_percent(spark):
    frame = spark.range(1000).select("id", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("y"))
    planted = cor.plant_defects(frame, "y", "id")
    assert planted.where(F.col("y") != F.col(cor.LEAKED)).count() == 5
    from plumbline.profile import associations as assoc
    from plumbline.profile.columns import classify

    cells = assoc.contingency(planted, [cor.LEAKED], "y", classify(planted))
    assert assoc.cramers_v(cells).first()["association"] > 0.95


def test_planting_guards(spark):
    frame = spark.createDataFrame([(1, 1.0), (2, None)], "id int, y double")
    with pytest.raises(ValueError, match="complete"):
        cor.plant_defects(frame, "y", "id")
    with pytest.raises(KeyError):
        cor.plant_defects(frame, "z", "id")
    with pytest.raises(ValueError, match="reserved"):
        cor.plant_defects(frame.withColumn(cor.LEAKED, F.lit(1)), "y", "id")
    with pytest.raises(ValueError, match="variance"):
        cor.plant_defects(frame.withColumn("y", F.lit(1.0)), "y", "id")


def test_sentinel(spark):
    frame = spark.createDataFrame([(1, 365243), (2, -10), (3, None)], "id int, days int")
    fixed, audit = cor.replace_sentinel(frame, "days", 365243)
    assert {tuple(r) for r in fixed.collect()} == {(1, None, True), (2, -10, False), (3, None, False)}
    row = audit.first()
    assert row["rows_corrected"] == 1 and row["cleaned_mean"] == -10.0


def test_hash_fold_is_plain_md5(spark):
    got = {r["id"]: r["f"] for r in spark.range(50).select("id", fold(F.col("id"), 5).alias("f")).collect()}
    assert got == {i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 5 for i in range(50)}


def many_labels(spark, n=1300):
    return spark.range(2 * n).select(
        "id", F.format_string("c%04d", F.col("id") % n).alias("cat"), F.format_string("c%04d", F.col("id") % n).alias("y")
    )


def test_encoders_take_any_number_of_categories(spark):
    fit = many_labels(spark)
    new = spark.createDataFrame([(0, "c0000"), (1, "c1299"), (2, "new"), (3, None)], "id long, cat string")
    made = {c: ft.transform(fit, new, [ft.ColumnSpec("cat", "none", c)], ["id"]) for c in ("ordinal", "onehot_vector", "onehot")}
    assert {tuple(r) for r in made["ordinal"].collect()} == {(0, 0), (1, 1299), (2, -1), (3, -1)}
    got = {r.id: r.cat for r in made["onehot_vector"].collect()}
    assert all(v.size == 1300 for v in got.values())
    assert {i: v.indices.tolist() for i, v in got.items()} == {0: [0], 1: [1299], 2: [], 3: []}
    rows = {r["id"]: r[1:] for r in made["onehot"].collect()}
    assert {i: [p for p, v in enumerate(r) if v] for i, r in rows.items()} == {0: [0], 1: [1299], 2: [], 3: []}


def test_label_leak_of_many_classes(spark):
    frame = many_labels(spark)
    planted = cor.plant_defects(frame, "y", "id")
    assert planted.columns[:3] == frame.columns
    moved = planted.where(F.col("y") != F.col(cor.LEAKED)).select("y", cor.LEAKED).collect()
    assert len(moved) == round(2600 * cor.FLIP_SHARE) and planted.count() == 2600
    assert all(int(b[1:]) == (int(a[1:]) + 1) % 1300 for a, b in moved)
    both = [(int(r.y[1:]), int(r[cor.LEAKED][1:])) for r in planted.collect()]
    assert cor.corruption_report(planted, "y").first().leaked_corr_with_target == pytest.approx(np.corrcoef(np.array(both).T)[0, 1])


def test_guards_as_rows(spark, rows):
    from plumbline.operators import corruption

    frame = spark.createDataFrame([("a", 1.0), ("a", None)], "t string, SYNTH_LEAKED double")
    assert rows(corruption.source_problems(frame, "t")) == [
        ("names_free", 1), ("target_complete", 0), ("target_present", 0), ("target_varies", 1),
    ]
    assert rows(corruption.source_problems(frame, "SYNTH_LEAKED").where("failing > 0")) == [
        ("names_free", 1), ("target_complete", 1), ("target_varies", 1),
    ]
    assert rows(corruption.source_problems(frame.limit(0), "gone")) == [
        ("names_free", 1), ("target_complete", 0), ("target_present", 1), ("target_varies", 1),
    ]
