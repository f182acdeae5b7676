"""Nearest neighbours and ridge against dense numpy."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from plumbline.operators import models, neighbours, ridge
from plumbline.operators.features import ColumnSpec


def squared(point, other):
    total = 0.0  # ``sum`` adds floats with more care
    for a, b in zip(point, other, strict=True):
        total += (a - b) * (a - b)
    return total


def plain(train, queries, k):
    out = {}
    for key, point in queries:
        near = sorted((squared(point, p), own, y) for own, p, y in train)[:k]
        out[key] = near
    return out


def frames(spark, train, queries):
    return (
        spark.createDataFrame(train, "key bigint, point array<double>, y double").repartition(4),
        spark.createDataFrame(queries, "key bigint, point array<double>").repartition(3),
    )


@pytest.mark.parametrize("dims, pivots", [(1, 3), (2, 16), (3, 64), (8, 10)])
def test_neighbours_equal_brute_force(spark, dims, pivots, monkeypatch):
    monkeypatch.setattr(neighbours, "RING", 7)
    monkeypatch.setattr(neighbours, "BLOCK", 11)
    monkeypatch.setattr(neighbours, "QUERIES", 13)
    rng = np.random.default_rng(dims)
    points = np.round(rng.normal(size=(300, dims)) * [10.0 ** (i % 2) for i in range(dims)], 1)
    train = [(i, p.tolist(), float(i % 4)) for i, p in enumerate(points)]
    train += [(1000 + i, points[0].tolist(), 9.0) for i in range(60)]  # copies of one point
    asked = np.round(rng.normal(size=(80, dims)) * 3, 1)
    queries = [(i, p.tolist()) for i, p in enumerate(asked)] + [(500 + i, points[0].tolist()) for i in range(40)] + [(999, [1e6] * dims)]
    told = {}
    got = neighbours.nearest(*frames(spark, train, queries), k=5, pivots=pivots, told=told).collect()
    assert {r["key"]: [tuple(n) for n in r["neighbours"]] for r in got} == plain(train, queries, 5)
    assert 0 <= told["share_skipped"] < 1


def test_cells_are_skipped(spark):
    rng = np.random.default_rng(1)
    points = rng.uniform(size=(2000, 2))
    train = [(i, p.tolist(), 0.0) for i, p in enumerate(points)]
    told = {}
    neighbours.nearest(*frames(spark, train, [(i, p) for i, p, _ in train[:300]]), told=told)
    assert told["share_skipped"] > 0.75


def test_visits_stay_few_as_points_grow(spark, monkeypatch):
    """Cells grow in number with the points, so a query meets a bounded number of points and not a share of them."""
    monkeypatch.setattr(neighbours, "RING", 64)
    rng = np.random.default_rng(3)
    pairs = {}
    for n in (8000, 32000):
        points = rng.uniform(size=(n, 2))
        train = [(i, p.tolist(), 0.0) for i, p in enumerate(points)]
        told = {}
        neighbours.nearest(*frames(spark, train, [(i, p) for i, p, _ in train[:200]]), told=told)
        pairs[n] = (1 - told["share_skipped"]) * n
    assert pairs[32000] < 1.5 * pairs[8000] < 1.5 * 64 * 16


def test_copies_of_points_and_of_keys(spark):
    train = [(i, [float(i % 3)], float(i)) for i in range(600)]
    asked = [(1, [0.0]), (1, [0.0]), (2, [2.0]), (3, [float("nan")])]
    got = {r["key"]: [n["key"] for n in r["neighbours"]] for r in neighbours.nearest(*frames(spark, train, asked), k=4).collect()}
    assert got == {1: [0, 0, 3, 3], 2: [2, 5, 8, 11]}


def test_few_and_no_training_rows(spark):
    train, queries = frames(spark, [(1, [0.0], 1.0), (2, [5.0], 0.0)], [(7, [1.0])])
    got = neighbours.nearest(train, queries).first()
    assert [n["key"] for n in got["neighbours"]] == [1, 2]
    assert neighbours.nearest(train.limit(0), queries).count() == 0
    assert neighbours.nearest(train, queries.limit(0)).count() == 0
    assert neighbours.votes(neighbours.nearest(train, queries)).first()["prediction"] == 0.0  # a tie: the smaller
    assert neighbours.mean_of(neighbours.nearest(train, queries)).first()["prediction"] == 0.5


def test_ridge_equals_dense(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) * [1, 50, 0.01] + [0, 1000, 3]
    y = x @ [2.0, -0.3, 40.0] + rng.normal(size=200) + 7
    rows = [(i, *map(float, r), 4.0, float(v), i % 4) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    frame = spark.createDataFrame(rows, "id bigint, a double, b double, c double, flat double, y double, fold int").repartition(5)
    names = ["a", "b", "c", "flat"]
    for standardize in (True, False):
        for model in ridge.ridge_by_fold(frame, names, "y", "fold", 1.0, standardize):
            own = np.array([r[1:5] for r in rows if r[6] != model.fold])
            target = np.array([r[5] for r in rows if r[6] != model.fold])
            width = np.where(own.std(axis=0) > 0, own.std(axis=0), 1.0) if standardize else np.ones(4)
            centred = (own - own.mean(axis=0)) / width
            beta = np.linalg.solve(centred.T @ centred + np.eye(4), centred.T @ (target - target.mean())) / width
            assert model.coefficients == pytest.approx(beta, rel=1e-8, abs=1e-10)
            assert model.intercept == pytest.approx(target.mean() - beta @ own.mean(axis=0), rel=1e-8)
    scored = ridge.score(frame, ridge.ridge_by_fold(frame, names, "y", "fold"), names, "y", "id", "fold")
    assert scored.count() == 4 * 200 and scored.where("split = 'validation'").count() == 200


def test_models_after_observed_metrics(spark):
    """A session that keeps observed metrics can't be serialised, and training summaries hold it."""
    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 5
    frame = spark.range(200).select("id", F.sin("id").alias("a"), (F.sin("id") > 0.2).cast("int").alias("y"))
    scored = models.cross_validate(frame, "y", "id", [ColumnSpec("a")], ["logreg", "rf", "knn"], True, k=2, trees=2)
    assert scored.where("split = 'validation'").count() == 3 * 200
    best = {r["model_id"]: r["val_score_mean"] for r in models.evaluate(scored, "binary").where("metric = 'roc_auc'").collect()}
    assert min(best.values()) > 0.95
