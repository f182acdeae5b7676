"""Substring de-duplication: Rabin-Karp hashes of word windows, counted in Spark.

Every window of ``length`` consecutive words has a rolling hash. To count only what can repeat, each
window is filed under its *anchor*: of the ``GRAM``-word sequences in it, the one of least hash, the
first of equals. Equal windows have equal anchors at equal distances, and windows that share an
anchor occurrence follow each other, so a document is a list of *stretches*: an anchor occurrence and
the words of its windows. In turn:

1. anchors are counted; a window whose anchor occurs once occurs once;
2. stretches with repeated anchors are counted by the hash of all their words; if a stretch repeats,
   so do all its windows;
3. windows of the stretches left over are counted against those of one example of every different
   stretch with the same anchor.

Repeated windows of a document are merged into maximal intervals, whose words go. Counts are of
128 bits (two independent 64-bit hashes) wherever they decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Chunks, Rows, binaries, documents, mixed, signed, staged, word_hashes

GRAM = 18
BASE_1 = 0xD6E8FEB86659FD93
BASE_2 = 0xA0761D6478BD642F
WORD = 1 << 64


class Roller:
    """Rolling hashes modulo 2^64 of sequences of word hashes, by prefix sums."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, WORD)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def powers(self, count: int) -> None:
        if count > len(self.up):
            size = max(count, 2 * len(self.up), 4096)
            self.up, self.down = (np.full(size, step, dtype=np.uint64) for step in (self.base, self.inverse))
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.cumprod(self.up, dtype=np.uint64), np.cumprod(self.down, dtype=np.uint64)

    def prefix(self, words: np.ndarray) -> np.ndarray:
        self.powers(len(words) + 1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.up[: len(words)], dtype=np.uint64)])

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((prefix[ends] - prefix[starts]) * self.down[starts])


ROLL_1, ROLL_2 = Roller(BASE_1), Roller(BASE_2)


def stretches(words: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, first window, number of windows) of each stretch, in order."""
    prefix = ROLL_1.prefix(words)
    grams = np.arange(len(words) - gram + 1)
    hashes = ROLL_1.spans(prefix, grams, grams + gram)
    width = length - gram + 1
    windows = np.lib.stride_tricks.sliding_window_view(hashes, width)
    anchors = np.argmin(windows, axis=1) + np.arange(len(windows))
    first = np.concatenate([[0], np.flatnonzero(np.diff(anchors)) + 1])
    return hashes[anchors[first]], first, np.diff(np.concatenate([first, [len(windows)]]))


STRETCH = pa.schema(
    [
        ("anchor", pa.int64()),
        ("whole_1", pa.int64()),
        ("whole_2", pa.int64()),
        ("doc_id", pa.int64()),
        ("text_hash", pa.int64()),
        ("first", pa.int32()),
        ("n", pa.int16()),
    ]
)
STRETCH_SQL = "anchor bigint, whole_1 bigint, whole_2 bigint, doc_id bigint, text_hash bigint, first int, n smallint"


def stretch_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Chunks(STRETCH)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            keys = batch.column("text_hash").to_numpy(zero_copy_only=False)
            for doc_id, key, text in zip(ids, keys, binaries(batch.column("text")), strict=True):
                split = text.split()
                if len(split) < length:
                    continue
                words = word_hashes(split, len(split))
                anchor, first, n = stretches(words, length, gram)
                ends = first + n - 1 + length
                out.add(
                    signed(anchor),
                    signed(ROLL_1.spans(ROLL_1.prefix(words), first, ends)),
                    signed(ROLL_2.spans(ROLL_2.prefix(words), first, ends)),
                    np.full(len(first), doc_id, dtype=np.int64),
                    np.full(len(first), key, dtype=np.int64),
                    first.astype(np.int32),
                    n.astype(np.int16),
                )
                if out.full():
                    yield from out.take()
        yield from out.take()

    return run


WINDOW = pa.schema(
    [("w_1", pa.int64()), ("w_2", pa.int64()), ("whole_1", pa.int64()), ("whole_2", pa.int64()), ("offset", pa.int16())]
)
WINDOW_SQL = "w_1 bigint, w_2 bigint, whole_1 bigint, whole_2 bigint, offset smallint"


def window_rows(length: int):
    """Windows of the listed stretches (array of first, n, whole_1, whole_2) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Chunks(WINDOW)
        for batch in batches:
            for text, listed in zip(binaries(batch.column("text")), batch.column("listed").to_pylist(), strict=True):
                split = text.split()
                words = word_hashes(split, len(split))
                n = np.array([x["n"] for x in listed])
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat([x["first"] for x in listed], n) + offset
                out.add(
                    signed(ROLL_1.spans(ROLL_1.prefix(words), at, at + length)),
                    signed(ROLL_2.spans(ROLL_2.prefix(words), at, at + length)),
                    np.repeat(np.array([x["whole_1"] for x in listed], dtype=np.int64), n),
                    np.repeat(np.array([x["whole_2"] for x in listed], dtype=np.int64), n),
                    offset.astype(np.int16),
                )
                if out.full():
                    yield from out.take()
        yield from out.take()

    return run


KEPT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("intervals", pa.list_(pa.list_(pa.int32()))),
        ("kept", pa.string()),
    ]
)
KEPT_SQL = "doc_id bigint, n_words bigint, n_removed bigint, intervals array<array<int>>, kept string"


def covered(count: int, found: list[dict], length: int) -> np.ndarray:
    """Which words the repeated windows cover; bit i of a mask is the window ``first + i``."""
    edges = np.zeros(count + 1, dtype=np.int64)
    for x in found:
        for i in range(int(x["mask"]).bit_length()):
            if x["mask"] >> i & 1:
                edges[x["first"] + i] += 1
                edges[x["first"] + i + length] -= 1
    return np.cumsum(edges[:-1]) > 0


def kept_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(KEPT)
        for batch in batches:
            for doc_id, text, found in zip(
                batch.column("doc_id").to_pylist(),
                binaries(batch.column("text")),
                batch.column("found").to_pylist(),
                strict=True,
            ):
                words = text.split()
                if found:
                    gone = covered(len(words), found, length)
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    words_left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    intervals = turns.reshape(-1, 2).tolist()
                else:
                    words_left, intervals = words, []
                body = b" ".join(words_left)
                out.add(doc_id, len(words), len(words) - len(words_left), intervals, body.decode(), size=len(body) + 64)
                if out.full():
                    yield from out.take()
        yield from out.take()

    return run


def repeated_windows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, text_hash, found: array of (first, mask)) of the documents with repeated windows."""
    pieces = docs.mapInArrow(stretch_rows(length, gram), STRETCH_SQL)
    common = pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_anchor")).filter("n_anchor > 1").select("anchor")
    live = staged(pieces.join(common, "anchor", "left_semi"), "stretches")
    # One row for every different stretch, with one place where it stands.
    whole = staged(
        live.groupBy("anchor", "whole_1", "whole_2").agg(
            F.count(F.lit(1)).alias("n_whole"), F.min(F.struct("doc_id", "text_hash", "first", "n")).alias("at")
        ),
        "different-stretches",
    )
    several = whole.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    listed = (
        whole.join(several, "anchor", "left_semi")
        .groupBy("at.doc_id", "at.text_hash")
        .agg(F.collect_list(F.struct("at.first", "at.n", "whole_1", "whole_2")).alias("listed"))
    )
    # Rows that repeat a document give its windows again, under the same stretch: they count once.
    windows = (
        docs.join(staged(listed, "listed"), ["doc_id", "text_hash"])
        .select("text", "listed")
        .mapInArrow(window_rows(length), WINDOW_SQL)
    )
    windows = staged(windows, "windows")
    again = (
        windows.groupBy("w_1", "w_2")
        .agg(
            F.min(F.struct("whole_1", "whole_2")).alias("low"),
            F.max(F.struct("whole_1", "whole_2")).alias("high"),
        )
        .filter("low <> high")
        .select("w_1", "w_2")
    )
    partly = (
        windows.join(again, ["w_1", "w_2"], "left_semi")
        .groupBy("whole_1", "whole_2")
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(offset as int))")).alias("mask"))
    )
    fully = whole.filter("n_whole > 1").select(
        "whole_1", "whole_2", F.expr("shiftleft(1L, cast(at.n as int)) - 1").alias("mask")
    )
    masks = fully.unionByName(partly).groupBy("whole_1", "whole_2").agg(F.bit_or("mask").alias("mask"))
    return (
        live.join(masks, ["whole_1", "whole_2"])
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list(F.struct("first", "mask")).alias("found"))
    )


def remove_repeats(
    docs: DataFrame, length: int = 35, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, intervals ([start, end) of words), kept (text).

    A word goes if a window of ``length`` words over it has a word sequence that starts elsewhere
    too, in this text or another. Null or empty texts have no words; texts shorter than ``length``
    stay whole. Rows that repeat are different places: they remove each other's windows. Rows
    without identifier take part like any other. ``length - gram`` must be below 62.
    """
    if not 0 < gram <= length <= gram + 61:
        raise ValueError("gram must be in [length - 61, length]")
    keyed = documents(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"
    )
    found = staged(repeated_windows(keyed, length, gram), "repeats")
    joined = keyed.join(found, ["doc_id", "text_hash"], "left").select("doc_id", "text", "found")
    result = joined.mapInArrow(kept_rows(length), KEPT_SQL)
    return result.withColumn("doc_id", F.nullif("doc_id", F.lit(-(2**63))))
