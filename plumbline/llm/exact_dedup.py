"""Exact de-duplication by content sort.

Normalised texts are range-partitioned by sampled splitters and sorted, so equal texts lie side by
side; each is compared in full with its neighbour. The splitters are drawn from (first characters,
digest, identifier): they stay short for any text, and a group of copies of any size spreads over
as many partitions as it needs. Only the first and the last run of a partition can go on in a
neighbour; one text of each of these runs is compared with the others in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ROW, Rows, binaries, documents, lowered, staged, with_row_key, without_rows

HEAD = 32
RUNS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("row", pa.int64()),
        ("text_sha256", pa.binary()),
        ("keep_id", pa.int64()),
        ("group_size", pa.int64()),
        ("first", pa.bool_()),
        ("part", pa.int32()),
        ("run", pa.int64()),
        ("edge", pa.bool_()),
        ("norm", pa.binary()),
    ]
)
RUNS_SQL = (
    "doc_id bigint, row bigint, text_sha256 binary, keep_id bigint, group_size bigint, first boolean, part int, run bigint, "
    "edge boolean, norm binary"
)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal texts in one sorted partition; of an edge run the first row has the text. Of an open run only the
    identifiers are held."""
    out = Rows(RUNS)
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    text: bytes | None = None
    digest = b""
    ids: list[tuple[int | None, int]] = []
    run = 0

    def close(edge: bool) -> None:
        for position, (doc_id, row) in enumerate(ids):
            body = text if edge and not position else None
            out.add(doc_id, row, digest, ids[0][0], len(ids), position == 0, part, run, edge, body, size=80 + len(body or b""))

    for batch in batches:
        for doc_id, row, sha, body in zip(
            batch.column("doc_id").to_pylist(),
            batch.column("row").to_pylist(),
            batch.column("sha").to_pylist(),
            binaries(batch.column("norm")),
            strict=True,
        ):
            if body != text:
                if ids:
                    close(run == 0)
                    run += 1
                text, digest, ids = body, sha, []
            ids.append((doc_id, row))
            if out.full():
                yield from out.take()
    if ids:
        close(True)
    yield from out.take()


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", row_col: str | None = None
) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, and ``row_col`` (a unique number) if there is one.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the
    smallest (or ``keep="largest"``) identifier stays. A row without identifier stays only if its
    group has no other; of rows that repeat the identifier that stays, one is kept. An empty table gives
    an empty result; other columns are not read.
    """
    descending = {"smallest": False, "largest": True}[keep]
    doc_id = F.col("doc_id").desc_nulls_last() if descending else F.col("doc_id").asc_nulls_last()
    sortable = documents(docs, id_col, text_col, *([] if row_col is None else [row_col]))
    sortable = sortable.select(
        "doc_id",
        # Rows that are alike in all else can lie in several partitions, too.
        (F.monotonically_increasing_id() if row_col is None else F.col(f"`{row_col}`")).alias("row"),
        lowered("text").alias("norm"),
    )
    sortable = sortable.withColumns(
        {"head": F.substring("norm", 1, HEAD), "sha": F.unhex(F.sha2(F.col("norm").cast("binary"), 256))}
    )
    order = ("head", "sha", doc_id, "row")
    ordered = sortable.repartitionByRange(*order).sortWithinPartitions(*order)
    found = staged(ordered.select("doc_id", "row", "sha", "norm").mapInArrow(runs, RUNS_SQL), "content-runs")
    # Two rows a partition at most.
    edges = found.filter("edge and first").select("norm", "part", "run", "keep_id", "group_size")
    best = F.max("keep_id") if descending else F.min("keep_id")
    totals = edges.groupBy("norm").agg(best.alias("all_keep"), F.sum("group_size").alias("all_size"), F.min("part").alias("first_part"))
    edges = edges.select("norm", "part", "run").join(totals, "norm").drop("norm")
    put = found.drop("norm").join(edges, ["part", "run"], "left")
    on_edge = F.col("first_part").isNotNull()
    return put.select(
        "doc_id",
        F.when(on_edge, F.col("all_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("all_size", "group_size").alias("group_size"),
        (F.col("first") & (~on_edge | (F.col("part") == F.col("first_part")))).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
        *([] if row_col is None else [F.col("row").alias(row_col)]),
    )


def without_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows that ``exact_duplicates`` keeps, with all their columns; null texts are empty, too.

    Decided row by row: of rows that repeat an identifier with the same text one stays, with another text
    it is another row; rows without identifier stay if no other of their text has one, and then once.
    """
    keyed = with_row_key(docs)
    found = exact_duplicates(keyed, keep=keep, row_col=ROW)
    return without_rows(keyed, staged(found.filter("not kept").select(ROW), "copies"))
