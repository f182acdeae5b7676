"""Exact nearest neighbours by space partition.

A tree of cuts across single dimensions, made from a bounded sample, deals all training points into cells of about
``RING`` points. A query is first compared with its own cell, whose k-th distance bounds the reach of the search, and then
with the other cells whose boxes lie within that reach. Copies of a point count as far as they can be neighbours (the k
smallest keys), and queries at one point are asked once. Cells are compared block by block: a block holds a bounded
number of training points, and its queries stream past them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.joins import lookup
from plumbline.session import shared_dir

NEIGHBOURS = 15
#: Cells at least, a parameter, if there are points for them; and at most, since the tree is made on the driver.
PIVOTS = 64
CELLS = 2048
#: Sampled points the tree is made from, for each cell.
SAMPLED = 16
#: Training points for each task that compares; few bytes mean much work here, so sizes alone would make too few tasks.
TASK = 8192
#: Training points of a cell, aimed at, and of a block, at most; queries of a block.
RING = 512
BLOCK = 1024
QUERIES = 4096
BEST = "array<struct<d2:double,key:bigint,y:double>>"


def stored(df: DataFrame, label: str) -> DataFrame:
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.empty((0, 0))


def squares(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances, dimension by dimension: the same sums as written out."""
    out = np.zeros((len(points), len(others)))
    for d in range(points.shape[1]):
        out += (points[:, d, None] - others[None, :, d]) ** 2
    return out


@dataclass(frozen=True)
class Cells:
    """A tree of cuts in arrays by node, children after their parent; a node without a dimension (-1) is a cell."""

    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    # The box of the training points below a node, known once they are dealt out.
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def place(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        node, rows = np.zeros(len(points), dtype=np.int64), np.arange(len(points))
        while len(rows):
            rows = rows[self.dim[node[rows]] >= 0]
            at = node[rows]
            node[rows] = np.where(points[rows, self.dim[at]] < self.cut[at], self.left[at], self.right[at])
        return node

    def within(self, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every cell whose box lies no farther than the squared reach of the row's point.

        Sums are rounded as those of ``squares``, and rounding keeps order, so no point of a box is nearer than it.
        """
        rows, node = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
        found = []
        while len(rows):
            away = np.zeros(len(rows))
            for d in range(points.shape[1]):
                own = points[rows, d]
                away += np.maximum(np.maximum(self.low[node, d] - own, own - self.high[node, d]), 0.0) ** 2
            near = away <= reach[rows]
            rows, node = rows[near], node[near]
            leaf = self.dim[node] < 0
            found.append((rows[leaf], node[leaf]))
            rows, node = rows[~leaf], node[~leaf]
            rows, node = np.concatenate([rows, rows]), np.concatenate([self.left[node], self.right[node]])
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def cuts(sample: np.ndarray, cells: int) -> Cells:
    """Cuts at medians across the widest dimension, until a cell has its share of the sample."""
    most = max(1, len(sample) // cells)
    nodes, waiting = [[-1, 0.0, -1, -1]], [(0, np.arange(len(sample)))]
    while waiting:
        node, rows = waiting.pop()
        if len(rows) <= most:
            continue
        own = sample[rows]
        widths = own.max(axis=0) - own.min(axis=0)
        dim = int(widths.argmax())
        if not widths[dim] > 0:
            continue
        values = own[:, dim]
        cut = np.partition(values, len(values) // 2)[len(values) // 2]
        if cut == values.min():
            cut = values[values > cut].min()
        nodes[node] = [dim, cut, len(nodes), len(nodes) + 1]
        waiting += [(len(nodes), rows[values < cut]), (len(nodes) + 1, rows[values >= cut])]
        nodes += [[-1, 0.0, -1, -1], [-1, 0.0, -1, -1]]
    dim, cut, left, right = zip(*nodes, strict=True)
    return Cells(*(np.array(x, dtype=np.int64) if x is not cut else np.array(x) for x in (dim, cut, left, right)))


def cells_of(points: DataFrame, rows: int, k: int, least: int) -> Cells:
    """The tree and its boxes; every cell has k points, if there are as many at all.

    A bounded sample, and a row a cell and dimension, reach the driver.
    """
    cells = min(CELLS, max(least, -(-rows // RING)))
    share = min(1.0, cells * SAMPLED / rows)
    picked = points.select("point").distinct()
    if share < 1.0:
        picked = picked.where(F.pmod(F.xxhash64("point"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = picked.collect() or points.select("point").limit(1).collect()
    tree = cuts(np.array(sorted(r["point"] for r in sample)), cells)

    schema = pa.schema([("cell", pa.int64()), ("dim", pa.int64()), ("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = matrix(batch.column("point"))
            cell = tree.place(own)
            order = np.argsort(cell, kind="stable")
            ids, starts, counts = np.unique(cell[order], return_index=True, return_counts=True)
            low, high = np.minimum.reduceat(own[order], starts), np.maximum.reduceat(own[order], starts)
            dims = own.shape[1]
            made = [np.repeat(ids, dims), np.tile(np.arange(dims), len(ids)), np.repeat(counts, dims), low.ravel(), high.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], schema=schema)

    boxes = points.select("point").mapInArrow(run, "cell bigint, dim bigint, n bigint, low double, high double")
    found = boxes.groupBy("cell", "dim").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    dims = max(r["dim"] for r in found) + 1
    count = np.zeros(len(tree.dim), dtype=np.int64)
    low, high = np.full((len(tree.dim), dims), np.inf), np.full((len(tree.dim), dims), -np.inf)
    for r in found:
        count[r["cell"]], low[r["cell"], r["dim"]], high[r["cell"], r["dim"]] = r["n"], r["low"], r["high"]
    dim = tree.dim.copy()
    for node in reversed(range(len(dim))):
        if tree.dim[node] >= 0:
            below = [tree.left[node], tree.right[node]]
            count[node], low[node], high[node] = count[below].sum(), low[below].min(axis=0), high[below].max(axis=0)
            if count[below].min() < k:
                dim[node] = -1
    return replace(tree, dim=dim, low=low, high=high)


def in_cells(points: DataFrame, cells: Cells) -> DataFrame:
    """Rows with the cell of their point."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = pa.array(cells.place(matrix(batch.column("point"))))
                yield pa.RecordBatch.from_arrays([*batch.columns, cell], names=[*batch.schema.names, "cell"])

    return points.mapInArrow(run, f"{ddl}, cell bigint")


def visits(found: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(id, point, reach, cell): the other cells in which a query can have neighbours, and its squared reach."""
    schema = pa.schema([("id", pa.int64()), ("point", pa.list_(pa.float64())), ("reach", pa.float64()), ("cell", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                points, reach = matrix(batch.column("point")), batch.column("reach").to_numpy()
                rows, cell = cells.within(points, reach)
                other = cell != cells.place(points)[rows]
                taken = pa.array(rows[other])
                own = [batch.column(c).take(taken) for c in ("id", "point", "reach")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(cell[other])], schema=schema)

    reach = F.when(F.size("best") < k, float("inf")).otherwise(F.element_at("best", -1)["d2"])
    return found.select("id", "point", reach.alias("reach")).mapInArrow(run, "id bigint, point array<double>, reach double, cell bigint")


FOUND = pa.schema(
    [
        ("id", pa.int64()),
        ("point", pa.list_(pa.float64())),
        ("best", pa.list_(pa.struct([("d2", pa.float64()), ("key", pa.int64()), ("y", pa.float64())]))),
    ]
)


def compared(k: int):
    """Blocks sorted by (cell, part, slice, kind): training points (kind 0) are held, queries stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: tuple | None = None
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.column_stack([batch.column(c).to_numpy() for c in ("cell", "part", "slice", "kind")])
            edges = np.flatnonzero(np.any(ids[1:] != ids[:-1], axis=1)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)], strict=True):
                own, kind = tuple(ids[a, :3].tolist()), ids[a, 3]
                if own != block:
                    block, held = own, []
                part = batch.slice(a, b - a)
                if kind == 0:
                    held.append(part)
                elif held:
                    table = pa.Table.from_batches(held).combine_chunks()
                    keys, ys = table.column("id").to_numpy(), table.column("y").to_numpy()
                    points = matrix(table.column("point").combine_chunks())
                    yield from nearest_in(part, points, keys, ys)

    def nearest_in(part, points, keys, ys):
        for at in range(0, part.num_rows, 256):
            queries = part.slice(at, 256)
            d2 = squares(matrix(queries.column("point")), points)
            limit = queries.column("reach").to_numpy()
            if len(keys) > k:
                limit = np.minimum(limit, np.partition(d2, k - 1, axis=1)[:, k - 1])
            # Everything as near as the k-th, then the smallest keys of equally near ones.
            rows, cols = np.nonzero(d2 <= limit[:, None])
            near = d2[rows, cols]
            order = np.lexsort((ys[cols], keys[cols], near, rows))
            rows, cols, near = rows[order], cols[order], near[order]
            kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            rows, cols, near = rows[kept], cols[kept], near[kept]
            asked, counts = np.unique(rows, return_counts=True)
            best = pa.StructArray.from_arrays([pa.array(x) for x in (near, keys[cols], ys[cols])], names=["d2", "key", "y"])
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            taken = pa.array(asked)
            yield pa.RecordBatch.from_arrays(
                [queries.column("id").take(taken), queries.column("point").take(taken), pa.ListArray.from_arrays(ends, best)],
                schema=FOUND,
            )

    return run


def compare(points: DataFrame, asked: DataFrame, k: int, tasks: int) -> DataFrame:
    """(id, point, best) of queries (id, point, reach, cell) against the points (key, point, y, cell) of their cells.

    Both sides of a cell are cut: its points into parts, its queries into slices.
    """
    parts = points.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    sizes = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("slices")).join(parts, "cell")
    # At most a row a cell.
    sizes = F.broadcast(sizes)
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("double")
    copies = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    held = points.join(sizes, "cell").select(
        "cell", F.pmod(F.xxhash64("key", "point"), "parts").alias("part"), copies("slices").alias("slice"),
        F.lit(0).alias("kind"), F.col("key").alias("id"), "point", "y", none.alias("reach"),
    )
    passing = asked.join(sizes, "cell").select(
        "cell", copies("parts").alias("part"), F.pmod(F.xxhash64("id"), "slices").alias("slice"),
        F.lit(1).alias("kind"), "id", "point", none.alias("y"), "reach",
    )
    block = ["cell", "part", "slice"]
    both = held.unionByName(passing).repartition(tasks, *block).sortWithinPartitions(*block, "kind")
    return both.mapInArrow(compared(k), f"id bigint, point array<double>, best {BEST}")


def nearest(train: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, pivots: int = PIVOTS, told: dict | None = None) -> DataFrame:
    """Per query key: ``neighbours``, its k nearest training rows as (d2, key, y), by distance and then key.

    ``train`` has key (bigint, unique), point (array of double, all as long) and y, ``queries`` key (unique)
    and point. With fewer than k training rows all of them are neighbours; without any the result is empty. A point with
    a missing or NaN entry is near nothing. ``told`` is filled with the number of (query, cell) pairs that were looked
    into and the share of those that were not.
    """
    whole = ~F.exists("point", lambda x: x.isNull() | F.isnan(x))
    place = F.row_number().over(Window.partitionBy("point").orderBy("key", "y"))
    points = train.where(whole).select("key", "point", "y").withColumn("_place", place).where(F.col("_place") <= k).drop("_place")
    points = stored(points, "points")
    rows = points.count()
    if not rows:
        return train.sparkSession.createDataFrame([], f"key bigint, neighbours {BEST}")
    once = queries.where(whole).select("point").distinct().withColumn("id", F.monotonically_increasing_id())
    asked = stored(once, "asked")
    cells, tasks = cells_of(points, rows, k, pivots), -(-rows // TASK)
    placed = stored(in_cells(points, cells), "cells")

    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
    mine = compare(placed, in_cells(asked.withColumn("reach", F.lit(float("inf"))), cells), k, tasks)
    own = stored(mine.groupBy("id").agg(F.any_value("point").alias("point"), best.alias("best")), "own")
    wanted = stored(visits(own, cells, k), "visits")
    if told is not None:
        many = asked.count()
        told["pairs"] = many + wanted.count()
        told["share_skipped"] = 1.0 - told["pairs"] / max(1, many * int((cells.dim < 0).sum()))

    lists = own.select("id", "point", "best").unionByName(compare(placed, wanted, k, tasks))
    found = lists.groupBy("id").agg(F.any_value("point").alias("point"), best.alias("best")).select("point", "best")
    answered = lookup(queries.where(whole).select("key", "point"), found, ["point"])
    return answered.where(F.col("best").isNotNull()).groupBy("key").agg(best.alias("neighbours"))


def votes(neighbours: DataFrame) -> DataFrame:
    """(key, prediction, share): the commonest y of the neighbours, the smallest of equally common ones."""
    counted = neighbours.select("key", F.size("neighbours").alias("_k"), F.explode("neighbours.y").alias("y")).groupBy("key", "_k", "y").count()
    best = counted.groupBy("key", "_k").agg(F.min(F.struct((-F.col("count")).alias("n"), "y")).alias("b"))
    return best.select("key", F.col("b.y").alias("prediction"), (-F.col("b.n") / F.col("_k")).alias("share"))


def mean_of(neighbours: DataFrame) -> DataFrame:
    """(key, prediction): the mean y of the neighbours."""
    total = F.aggregate("neighbours", F.lit(0.0), lambda t, n: t + n["y"])
    return neighbours.select("key", (total / F.size("neighbours")).alias("prediction"))
