import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import models
from plumbline.operators.features import ColumnSpec


def points(spark, n=300):
    return spark.range(n).select(
        "id",
        (F.sin(F.col("id") * 1.3) * 3).alias("a"),
        F.cos(F.col("id") * 0.7).alias("b"),
        F.concat(F.lit("c"), (F.col("id") % 6).cast("string")).alias("c"),
    )


def by_metric(summary):
    return {(r["model_id"], r["metric"]): r for r in summary.collect()}


def test_ridge_finds_a_linear_relation(spark):
    frame = points(spark).withColumn("y", F.col("a") * 2.0 - F.col("b") + 5.0)
    scored = models.cross_validate(frame, "y", "id", [ColumnSpec("a"), ColumnSpec("b")], ["linreg"], False)
    assert scored.where("split = 'validation'").count() == 300
    got = by_metric(models.evaluate(scored, "regression"))
    assert got[("linreg", "r2")]["val_score_mean"] > 0.999 and got[("linreg", "r2")]["usable_folds"] == 5
    # Penalty as in ridge regression with one weight for the whole data set.
    train = np.array([[r["a"], r["b"], r["y"]] for r in frame.collect()])
    x, y = train[:, :2] - train[:, :2].mean(0), train[:, 2] - train[:, 2].mean()
    beta = np.linalg.solve(x.T @ x + np.eye(2), x.T @ y)
    assert beta == pytest.approx([2.0, -1.0], abs=0.02)


@pytest.mark.parametrize("model_id, trees", [("logreg", 1), ("rf", 5), ("gbt", 4)])
def test_classifiers_learn_a_threshold(spark, model_id, trees):
    frame = points(spark).withColumn("y", (F.col("a") > 0.5).cast("int"))
    specs = [ColumnSpec("a", scaling="standard"), ColumnSpec("b", scaling="robust"), ColumnSpec("c", encoding="target")]
    scored = models.cross_validate(frame, "y", "id", specs, [model_id], True, k=3, trees=trees)
    got = by_metric(models.evaluate(scored, "binary"))
    assert got[(model_id, "roc_auc")]["val_score_mean"] > 0.97
    assert got[(model_id, "roc_auc")]["usable_folds"] == 3


def test_scored_rows_are_written_model_by_model_and_read_by_one_scan(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(models, "shared_dir", lambda _, label: str(tmp_path / label))
    frame = points(spark, 120).withColumn("y", (F.col("a") > 0.5).cast("int"))
    scored = models.cross_validate(frame, "y", "id", [ColumnSpec("a"), ColumnSpec("b")], ["gbt", "knn"], True, k=2, trees=2)
    assert "Union" not in scored._jdf.queryExecution().optimizedPlan().toString()
    folders = list((tmp_path / "scored").iterdir())
    assert len(folders) == 2 * 2 * 2
    for folder in folders:
        assert spark.read.parquet(str(folder)).select("model_id", "fold", "split").distinct().count() == 1
    counts = {(r["model_id"], r["split"]): r["count"] for r in scored.groupBy("model_id", "split").count().collect()}
    assert counts == {(m, s): 120 for m in ("gbt", "knn") for s in ("train", "validation")}


def test_wrong_model_for_the_task():
    with pytest.raises(ValueError):
        models.estimator("linreg", True, 2, 10)
    with pytest.raises(ValueError):
        models.estimator("knn", True, 2, 10)
