"""Ridge regression of all folds from one pass over the data.

Each task multiplies its batches into one Gram matrix a fold; the training side of a fold is the total
minus its own matrix, and its coefficients are one small solve. Rows are read again only to be scored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = pa.schema([("fold", pa.int32()), ("i", pa.int32()), ("products", pa.list_(pa.float64()))])


@dataclass(frozen=True)
class Ridge:
    fold: int
    intercept: float
    coefficients: tuple[float, ...]


def fold_grams(df: DataFrame, names: Sequence[str], label: str, fold: str, shift: Sequence[float]) -> dict[int, np.ndarray]:
    """Gram matrix of (1, names, label), less ``shift``, of each fold. Rows with a NULL are left out.

    What reaches the driver is one cell for each fold and pair of columns.
    """
    columns = [*names, label]
    centre = np.array(shift, dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            folds = batch.column(0).to_numpy()
            rows = np.column_stack([batch.column(i + 1).to_numpy() for i in range(len(columns))]) - centre
            rows = np.column_stack([np.ones(len(rows)), rows])
            for own in np.unique(folds).tolist():
                part = rows[folds == own]
                found[own] = found.get(own, 0.0) + part.T @ part
        for own, gram in found.items():
            size = len(gram)
            yield pa.RecordBatch.from_arrays(
                [pa.array([own] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(gram.tolist(), GRAM.field(2).type)],
                schema=GRAM,
            )

    picked = df.select(F.col(fold).cast("int").alias("fold"), *[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    parts = picked.dropna().mapInArrow(run, "fold int, i int, products array<double>")
    cells = parts.select("fold", "i", F.posexplode("products").alias("j", "product"))
    size = len(columns) + 1
    grams: dict[int, np.ndarray] = {}
    for row in cells.groupBy("fold", "i", "j").agg(F.sum("product").alias("product")).collect():
        grams.setdefault(row["fold"], np.zeros((size, size)))[row["i"], row["j"]] = row["product"]
    return grams


def solve(gram: np.ndarray, shift: Sequence[float], penalty: float, standardize: bool) -> tuple[float, tuple[float, ...]]:
    """Intercept and coefficients of the rows behind a Gram matrix; the intercept bears no penalty.

    With ``standardize`` the penalty is on coefficients of columns divided by their deviation (ddof 0). A
    column without variance has the coefficient 0.
    """
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    scatter = gram[1:, 1:] - n * np.outer(mean, mean)
    width = np.sqrt(np.maximum(np.diag(scatter)[:-1], 0.0) / n) if standardize else np.ones(len(mean) - 1)
    width = np.where(width > 0, width, 1.0)
    x = scatter[:-1, :-1] / np.outer(width, width)
    found = np.linalg.solve(x + penalty * np.eye(len(width)), scatter[:-1, -1] / width) / width
    centre = mean + np.array(shift)
    return float(centre[-1] - found @ centre[:-1]), tuple(found.tolist())


def ridge_by_fold(
    df: DataFrame, names: Sequence[str], label: str, fold: str, penalty: float = 1.0, standardize: bool = True
) -> list[Ridge]:
    """One model for each fold, fitted on the rows of all others."""
    means = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate([*names, label])]).first()
    shift = [m or 0.0 for m in means]
    grams = fold_grams(df, names, label, fold, shift)
    total = sum(grams.values())
    if len(grams) < 2:
        raise ValueError("ridge by fold needs rows in at least two folds")
    return [Ridge(own, *solve(total - gram, shift, penalty, standardize)) for own, gram in sorted(grams.items())]


def score(df: DataFrame, models: Sequence[Ridge], names: Sequence[str], label: str, key: str, fold: str) -> DataFrame:
    """(model_id, fold, split, key, y, score, prediction): each row under every model, as its own fold's validation."""
    number = F.explode(F.array(*[F.lit(i) for i in range(len(models))])).alias("_model")
    values = [F.col(f"`{c}`").cast("double") for c in names]
    wide = df.select(key, F.col(fold).cast("int").alias("_fold"), F.col(f"`{label}`").cast("double").alias("y"), F.array(*values).alias("_x"), number)
    place = F.col("_model") + 1
    prediction = F.element_at(F.array(*[F.lit(m.intercept) for m in models]), place)
    for j in range(len(names)):
        weight = F.element_at(F.array(*[F.lit(m.coefficients[j]) for m in models]), place)
        prediction = prediction + weight * F.col("_x")[j]
    held_out = F.element_at(F.array(*[F.lit(m.fold) for m in models]), place)
    return wide.select(
        F.lit("linreg").alias("model_id"),
        held_out.alias("fold"),
        F.when(F.col("_fold") == held_out, "validation").otherwise("train").alias("split"),
        key,
        "y",
        prediction.alias("score"),
        prediction.alias("prediction"),
    )
