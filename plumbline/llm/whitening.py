"""Whitening of embeddings by weighted multiplicity covariance.

Vectors are brought to whole numbers, identical ones are grouped and counted, and everything is
fitted on and applied to the distinct ones: exact sums, then the centred matrix product of each
partition, added up by row of the matrix. A distinct vector is whitened once and joined back to the
rows that hold it. Groups of copies that hold more than a thousandth of the rows are dealt in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import staged

SCALE = 256
COMPONENTS = 4
#: The matrix of so many dimensions is held by the driver; more are refused.
MAX_DIMS = 4096
#: A group of copies with more than this share of the rows is dealt in parts of that share.
PARTS = 1000
#: Rows that are turned into matrices at once.
ROWS_AT_ONCE = 4096
TOP = np.iinfo(np.int64).max
WIDTHS = tuple(np.dtype(f"<i{w}") for w in (1, 2, 4, 8))


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * c) as long; beyond the range of a long its least or greatest value."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * float(scale))
    inside = np.abs(scaled) < 2.0**63
    out = np.where(inside, scaled, 0.0).astype(np.int64)
    out[~inside] = np.where(scaled[~inside] > 0, TOP, -TOP - 1)
    return out


def encoded(x: np.ndarray) -> bytes:
    """A vector in the narrowest integers that hold it, after their width: equal vectors, equal bytes."""
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    kind = next(k for k in WIDTHS if low >= np.iinfo(k).min and high <= np.iinfo(k).max)
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def matrix(vectors: list[bytes], dims: int) -> np.ndarray:
    """Encoded vectors of ``dims`` entries as the rows of an int64 matrix."""
    out = np.empty((len(vectors), dims), dtype=np.int64)
    widths = np.array([v[0] for v in vectors], dtype=np.int64)
    for kind in WIDTHS:
        own = np.flatnonzero(widths == kind.itemsize)
        if len(own):
            body = b"".join([vectors[i][1:] for i in own.tolist()])
            out[own] = np.frombuffer(body, dtype=kind).reshape(len(own), dims)
    return out


KEYED = pa.schema([("vec_id", pa.int64()), ("dims", pa.int32()), ("x", pa.binary())])


def keyed(embeddings: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dims, x) of the rows whose vector is whole and finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                vectors = part.column("vector")
                ends = vectors.offsets.to_numpy().astype(np.int64)
                first, ends = ends[0], ends - ends[0]
                values = vectors.values.slice(first, ends[-1]).to_numpy(zero_copy_only=False).astype(np.float64)
                bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
                good = (bad[ends[1:]] == bad[ends[:-1]]) & ~vectors.is_null().to_numpy(zero_copy_only=False)
                x = whole(np.where(np.isfinite(values), values, 0.0), scale)
                keep = np.flatnonzero(good)
                spans = [(ends[i], ends[i + 1]) for i in keep.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(keep)),
                        pa.array([b - a for a, b in spans], pa.int32()),
                        pa.array([encoded(x[a:b]) for a, b in spans], pa.binary()),
                    ],
                    schema=KEYED,
                )

    picked = embeddings.select(
        F.col(f"`{id_col}`").cast("bigint").alias("vec_id"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("vector"),
    )
    return picked.mapInArrow(run, "vec_id bigint, dims int, x binary")


def weighed(batches: Iterator[pa.RecordBatch], dims: int, by_count: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, matrix, weights) of the distinct vectors, a bounded number at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            copies = part.column("copies").to_numpy()
            yield part, matrix(part.column("x").to_pylist(), dims), copies if by_count else np.ones_like(copies)


def fit_sums(distinct: DataFrame, dims: int, by_count: bool) -> tuple[int, list[int]]:
    """Total weight and weighted sums by dimension, exact."""
    schema = pa.schema([("dim", pa.int32()), ("total", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * (dims + 1)
        for _, x, weights in weighed(batches, dims, by_count):
            if float(np.abs(x).max(initial=0)) * float(weights.sum()) >= 2.0**62:
                x = x.astype(object)
            for i, value in enumerate((x * weights[:, None]).sum(axis=0).tolist()):
                totals[i] += int(value)
            totals[dims] += int(weights.sum())
        if totals[dims]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dims + 1), pa.int32()), pa.array(list(map(Decimal, totals)), pa.decimal128(38, 0))], schema=schema
            )

    parts = distinct.mapInArrow(run, "dim int, total decimal(38,0)")
    sums = {r.dim: int(r.total) for r in parts.groupBy("dim").agg(F.sum("total").alias("total")).collect()}
    return sums[dims], [sums[i] for i in range(dims)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: Python integers where a long could overflow."""
    most = max(map(abs, sums), default=0)
    if float(np.abs(x.astype(np.float64)).max(initial=0)) * n + most >= 2.0**62:
        return x.astype(object) * n - np.array(sums, dtype=object)
    return x * n - np.array(sums, dtype=np.int64)


def fit_covariance(distinct: DataFrame, dims: int, n: int, sums: list[int], by_count: bool) -> np.ndarray:
    """Weighted covariance, divisor ``n``: products of centred vectors by partition, added up by matrix row."""
    schema = pa.schema([("i", pa.int32()), ("products", pa.list_(pa.float64()))])
    sql = "i int, products array<double>"

    def rows(found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i, products in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([products.tolist()], schema.field(1).type)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        empty = True
        for _, x, weights in weighed(batches, dims, by_count):
            centred = deviations(x, n, sums).astype(np.float64) / n
            total += centred.T @ (centred * weights[:, None].astype(np.float64))
            empty = False
        if not empty:
            yield from rows(dict(enumerate(total)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            products = batch.column("products")
            for at, i in enumerate(batch.column("i").to_pylist()):
                own = products[at].values.to_numpy()
                found[i] = found[i] + own if i in found else own
        yield from rows(found)

    summed = distinct.mapInArrow(run, sql).repartition("i").mapInArrow(add, sql).collect()
    out = np.zeros((dims, dims))
    for row in summed:
        out[row.i] = row.products
    return (out + out.T) / (2.0 * n)


def principal(covariance: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest eigenvalues and their unit eigenvectors (columns), whose greatest entry is positive."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:count]
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values[order], vectors * signs


def whiten_distinct(distinct: DataFrame, dims: int, n: int, sums: list[int], axes: np.ndarray) -> DataFrame:
    """(x, copies, deviation, whitened) of each distinct vector; ``axes`` has NaN columns where there is no variance."""
    schema = pa.schema([("x", pa.binary()), ("copies", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, _ in weighed(batches, dims, False):
            apart = deviations(x, n, sums)
            if apart.dtype != object and float(np.abs(apart).max(initial=0)) ** 2 * max(dims, 1) >= 2.0**62:
                apart = apart.astype(object)
            squares = [int(s) for s in (apart * apart).sum(axis=1).tolist()]
            white = (apart.astype(np.float64) / n) @ axes
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("x"),
                    part.column("copies"),
                    pa.array([s if s <= TOP else None for s in squares], pa.int64()),
                    pa.array(white.tolist(), schema.field(3).type),
                ],
                schema=schema,
            )

    return distinct.mapInArrow(run, "x binary, copies bigint, deviation bigint, whitened array<double>")


def identity_error(white: DataFrame, n: int, kept: list[int], by_count: bool) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity, over the fit list."""
    weight = F.col("copies").cast("double") if by_count else F.lit(1.0)
    entry = {c: F.col("whitened")[c] for c in kept}
    means = white.agg(*(F.sum(weight * entry[c]).alias(f"m{c}") for c in kept)).first()
    centred = {c: entry[c] - F.lit(means[f"m{c}"] / n) for c in kept}
    pairs = [(a, b) for a in kept for b in kept if a <= b]
    products = white.agg(*(F.sum(weight * centred[a] * centred[b]).alias(f"p{a}_{b}") for a, b in pairs)).first()
    return max(abs(products[f"p{a}_{b}"] / n - (a == b)) for a, b in pairs)


RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(
    embeddings: DataFrame,
    scale: int = SCALE,
    components: int = COMPONENTS,
    weights: str = "one",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or has null or non-finite entries go. Entries become floor(scale * c)
    (the least or greatest long if it is none), and each distinct vector is fitted with weight one
    (``weights="count"``: the number of its rows); ``n`` is the sum of weights. Vectors of another
    length than the commonest (of rows; the greater of equally common ones) have no covariance with
    the rest and go, too. ``deviation`` is null where it is no long. A component without variance has a
    null ``whitened`` and takes no part in ``identity_error``, which is null if no component has any;
    ``explained`` is null where nothing varies. There are as many components as dimensions at most:
    none, and so no rows, for an empty table or empty vectors. Rows without identifier and repeated
    rows come back as often as they are there.
    """
    by_count = {"one": False, "count": True}[weights]
    spark = embeddings.sparkSession
    rows = keyed(embeddings, scale, id_col, vector_col)
    distinct = staged(rows.groupBy("dims", "x").agg(F.count(F.lit(1)).alias("copies")), "distinct-vectors")
    common = distinct.groupBy("dims").agg(F.sum("copies").alias("rows")).orderBy(F.desc("rows"), F.desc("dims")).first()
    dims = common.dims if common else 0
    if not dims:
        return spark.createDataFrame([], RESULT)
    if dims > MAX_DIMS:
        raise ValueError(f"{dims} dimensions are over the bound of {MAX_DIMS}")
    fit = distinct.filter(F.col("dims") == dims).select("x", "copies")
    n, sums = fit_sums(fit, dims, by_count)
    covariance = fit_covariance(fit, dims, n, sums, by_count)
    values, axes = principal(covariance, min(components, dims))
    trace = float(np.trace(covariance))
    kept = [i for i, e in enumerate(values.tolist()) if e > max(values[0], 0.0) * dims * np.finfo(float).eps]
    scaled = np.full_like(axes, np.nan)
    scaled[:, kept] = axes[:, kept] / np.sqrt(values[kept])
    white = staged(whiten_distinct(fit, dims, n, sums, scaled), "whitened")
    error = identity_error(white, n, kept, by_count) if kept else None

    # More than a thousandth of the rows each: a thousand groups at most.
    share = max(1, common.rows // PARTS)
    parts = F.ceil(F.col("copies") / share).cast("bigint")
    hot = white.filter(F.col("copies") > share).select("x", parts.alias("parts"))
    dealt = (
        rows.filter(F.col("dims") == dims)
        .join(F.broadcast(hot), "x", "left")
        .select("vec_id", "x", F.coalesce(F.pmod(F.monotonically_increasing_id(), "parts"), F.lit(0)).alias("part"))
    )
    copied = white.select(
        "x",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("copies") > share, parts - 1).otherwise(0))).alias("part"),
        "deviation",
        "whitened",
    )
    explained = F.array(*(F.lit(float(max(e, 0.0)) / trace if trace > 0 else None).cast("double") for e in values.tolist()))
    return (
        dealt.join(copied, ["x", "part"])
        .select("vec_id", "deviation", F.posexplode("whitened").alias("place", "white"))
        .select(
            "vec_id",
            (F.col("place") + 1).cast("int").alias("component"),
            F.lit(n).cast("bigint").alias("n"),
            "deviation",
            F.nanvl("white", F.lit(None).cast("double")).alias("whitened"),
            F.get(explained, F.col("place")).alias("explained"),
            F.lit(error).cast("double").alias("identity_error"),
        )
    )
