"""Cross-validated Spark ML models.

One fit per fold and model. Preprocessing is fitted on the training folds only; the scored rows of
all folds form one table, so every metric is one aggregation over it.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import classification as mlc
from pyspark.ml import regression as mlr
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions.hashing import fold as hash_fold
from plumbline.operators import evaluation as ev
from plumbline.operators.neighbours import mean_of, nearest, stored, votes
from plumbline.operators.features import (
    ColumnSpec,
    apply_target_encoding,
    fit_columns,
    out_of_fold_encoding,
    target_encoding,
)
from plumbline.session import shared_dir

# Model settings.
TREES = 300
BOOST_DEPTH = 6
BOOST_RATE = 0.1
#: Depth of a forest's trees: a parameter, by default the deepest that Spark ML grows.
MAX_DEPTH = 30
PENALTY = 1.0
INNER = 5


def estimator(model_id: str, classification: bool, classes: int, rows: int, trees: int = TREES, depth: int = MAX_DEPTH):
    """Spark ML estimator of a model id; the penalty is per data set, Spark's is per row."""
    common = {"featuresCol": "features", "labelCol": "y", "seed": 42}
    if model_id == "logreg" and classification:
        return mlc.LogisticRegression(
            featuresCol="features", labelCol="y", maxIter=1000, regParam=PENALTY / max(rows, 1), standardization=False
        )
    if model_id == "linreg" and not classification:
        return mlr.LinearRegression(
            featuresCol="features", labelCol="y", regParam=PENALTY / max(rows, 1), standardization=False
        )
    if model_id == "rf":
        kind = mlc.RandomForestClassifier if classification else mlr.RandomForestRegressor
        return kind(numTrees=trees, maxDepth=depth, **common)
    if model_id == "gbt":
        settings = {"maxIter": trees, "maxDepth": BOOST_DEPTH, "stepSize": BOOST_RATE, **common}
        if not classification:
            return mlr.GBTRegressor(**settings)
        boosted = mlc.GBTClassifier(**settings)
        return boosted if classes == 2 else mlc.OneVsRest(classifier=boosted, featuresCol="features", labelCol="y")
    raise ValueError(f"model {model_id!r} is not available for this task")


def with_folds(df: DataFrame, label: str, key: str, classification: bool, k: int = 5) -> DataFrame:
    if classification:
        return ev.stratified_folds(df, label, key, k)
    return df.withColumn("fold", hash_fold(F.col(key), k, "fold"))


def fold_features(df: DataFrame, held_out: int, specs: Sequence[ColumnSpec], label: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Training and validation features of one fold, every statistic from its training rows.

    Target-encoded columns are out of fold on the training rows, over ``INNER`` folds of their own, and use
    the whole training mapping on the validation rows.
    """
    df = df.withColumn("inner", hash_fold(F.col(key), INNER, "inner"))
    train, valid = df.where(F.col("fold") != held_out), df.where(F.col("fold") == held_out)
    plain = [s for s in specs if s.encoding != "target"]
    keep = [key, "fold", "inner", label, *[s.name for s in specs if s.encoding == "target"]]
    fitted = fit_columns(train, plain)
    made = [fitted.apply(part, keep) for part in (train, valid)]
    for spec in specs:
        if spec.encoding != "target":
            continue
        stats, prior = target_encoding(train, spec.name, label)
        coded = f"{spec.name}_target"
        made[0] = out_of_fold_encoding(made[0], spec.name, label, "inner", coded).drop(spec.name)
        made[1] = apply_target_encoding(made[1], stats, spec.name, prior, coded).drop(spec.name)
    inputs = [c for c in made[0].columns if c not in (key, "fold", "inner", label)]
    assembler = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")
    train_v, valid_v = (
        assembler.transform(m).select(key, "fold", F.col(label).cast("double").alias("y"), "features") for m in made
    )
    return train_v, valid_v


def cross_validate(
    df: DataFrame,
    label: str,
    key: str,
    specs: Sequence[ColumnSpec],
    model_ids: Sequence[str],
    classification: bool,
    k: int = 5,
    trees: int = TREES,
    parallel: int = 5,
) -> DataFrame:
    """Scored rows of every model and fold: (model_id, fold, split, key, y, score, prediction).

    Labels of a classification are codes from zero (``features.label_codes``).

    Every model's rows are written on their own and read back by one scan: a plan over all models and folds, which Spark
    plans again after each of its stages, fills the driver whatever the size of the table.
    """
    folded = stored(with_folds(df.select(key, label, *[s.name for s in specs]), label, key, classification, k), "folded")
    classes = folded.agg(F.count_distinct(label)).first()[0] if classification else 0
    folder = shared_dir(df.sparkSession, "scored")

    def one_fold(held_out: int) -> list[tuple[str, StructType]]:
        train, valid = (stored(part, "features") for part in fold_features(folded, held_out, specs, label, key))
        rows = train.count()
        scored = []
        for model_id in model_ids:
            model = None if model_id == "knn" else bare(estimator(model_id, classification, classes, rows, trees).fit(train))
            for split, part in (("train", train), ("validation", valid)):
                if model is None:
                    made = by_neighbours(train, part, key, classification, classes)
                else:
                    made = model.transform(part)
                    binary = classification and classes == 2 and "probability" in made.columns
                    made = made.withColumn("score", vector_to_array("probability")[1] if binary else F.col("prediction"))
                made = made.select(
                    F.lit(model_id).alias("model_id"),
                    F.lit(held_out).alias("fold"),
                    F.lit(split).alias("split"),
                    key,
                    "y",
                    "score",
                    "prediction",
                )
                # Stored, so that nothing of a fold's fits has to be done or sent again.
                path = f"{folder}/{held_out}-{model_id}-{split}"
                made.write.parquet(path)
                scored.append((path, made.schema))
        return scored

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        parts = [part for parts in pool.map(one_fold, range(k)) for part in parts]
    return df.sparkSession.read.schema(parts[0][1]).parquet(*[path for path, _ in parts])


def bare(model):
    """The fitted model without its training summary, which holds the session: once that keeps observed metrics, a
    model with a summary can't be sent to executors any more."""
    if not getattr(model, "hasSummary", False):
        return model
    path = shared_dir(SparkSession.active(), "model")
    model.write().save(path)
    return type(model).load(path)


def by_neighbours(train: DataFrame, part: DataFrame, key: str, classification: bool, classes: int) -> DataFrame:
    """``part`` with prediction and score of its nearest training rows; a training row is its own neighbour."""
    point = vector_to_array("features").alias("point")
    found = nearest(
        train.select(F.col(key).cast("bigint").alias("key"), point, "y"), part.select(F.col(key).cast("bigint").alias("key"), point)
    )
    # Read twice below.
    found = stored(found, "neighbours")
    if not classification:
        told = mean_of(found).withColumn("score", F.col("prediction"))
    else:
        ones = F.size(F.filter("neighbours", lambda n: n["y"] == 1.0)) / F.size("neighbours")
        told = votes(found).drop("share")
        told = told.join(found.select("key", ones.alias("score")), "key") if classes == 2 else told.withColumn("score", F.col("prediction"))
    return part.join(told.withColumnRenamed("key", "_key"), F.col(key).cast("bigint") == F.col("_key"))


def evaluate(scored: DataFrame, task: str) -> DataFrame:
    """Fold summaries of every metric of the task, train and validation side by side."""
    by = ("model_id", "fold", "split")
    if task == "binary":
        metrics = ev.binary_metrics(scored, by).unionByName(ev.ranking_metrics(scored, by))
    elif task == "regression":
        metrics = ev.regression_metrics(scored, by)
    else:
        metrics = ev.class_metrics(scored, by)
    return ev.overfitting(ev.fold_summary(metrics))
