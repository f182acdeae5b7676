"""Token ids in Parquet: sorted files of list columns that can be read selectively.

Documents are range-partitioned by identifier and sorted, each task tokenises its range and writes
one file. Token ids are dictionary-encoded or (``encoding="delta"``) written as DELTA_BINARY_PACKED
by the version 2 page format. Row groups and pages are kept small, and the column and offset indexes
that Spark's writer adds let a reader fetch the pages of some documents, or the metadata columns
alone. Start positions are prefix sums: totals of files first, then inside each file.
"""

from __future__ import annotations

import codecs
import functools
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import documents, scratch

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
#: Words whose ids a worker remembers; it starts anew beyond that.
REMEMBERED = 1_000_000
JOINT = 256
#: Bytes of text that are encoded together: the more, the fewer times a common word is looked up; a longer text goes alone.
PORTION_BYTES = 4 << 20
SCHEMA_SQL = "doc_id bigint, n_tokens int, ids array<int>"
TOKENS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))])


class WordTokens:
    """Word to its ids as bytes, filled by the tokenizers library.

    Texts are cut at spaces and line feeds, which this kind of tokenizer drops and never joins over,
    and before a comma or full stop that ends a word; A-Z are lowered, as it does. Each distinct word
    is encoded once. Words are sent to the library many at a time, with a mark between them whose id
    tells the cuts.
    """

    MARK = "^"
    #: A comma or full stop after anything but a letter, number or space belongs to its run and can't be
    #: cut off (tested on composed text, as some letters fall into two). The run holds ``_``, too, and
    #: the dot that a lowered capital I with dot leaves.
    IN_RUN = re.compile(r"[.,](?<=(?:[^\w ]|[_\u0130]).)(?:\s|\Z)")
    #: Capitals that compose with a mark only once they are lowered; the tokenizer lowers them after.
    MARKED = re.compile(r"[HJTWY][^\x00-\xbf\w\u2000-\u206f]")

    #: Words of these characters alone are normal already, and cut as the tokenizer cuts them into pieces (no
    #: apostrophe, since it has endings of its own): the library's model is asked for these directly, without the
    #: steps before it. That it says the same is tried on ``PROBE``.
    PLAIN = re.compile(r"[a-z0-9ß-öø-ÿ!-&(-/:-@\[-`{-~]+")
    PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
    PROBE = ("the", "ß", "zoë", "unwahrscheinlichkeit", "10.5%", "a_b-c", "x1y22...", "(über)", "<b>", "^", "*?`~")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tool = Tokenizer.from_file(path)
        #: Tokens that the library finds in the text before anything else; texts with one are encoded whole,
        #: and so are those that would only have one once their capitals are lowered.
        self.added = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        self.heads = {c for t in self.added for c in (t[:1], t[:1].upper())}
        self.mark = self.tool.encode(self.MARK, add_special_tokens=False).ids
        #: The letter that the model's vocabulary has for each byte; those of plain ASCII and first bytes are their own.
        spelt = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = "".join(spelt(chr(c))[0][0][-1] if 0x80 <= c < 0xC0 else chr(c) for c in range(0x100))
        self.digits = {digit: self.piece(digit) for digit in "0123456789"}
        self.direct = all(self.one(word) == self.modelled(word) for word in self.PROBE)
        self.known: dict[str, bytes] = {"": b""}

    def piece(self, text: str) -> bytes:
        letters = text if text.isascii() else codecs.charmap_decode(text.encode(), "strict", self.spelling)[0]
        ids = [t.id for t in self.tool.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def modelled(self, word: str) -> bytes:
        pieces = self.PIECES.findall(word)
        if len(pieces) == 1:
            return self.digits.get(word) or self.piece(word)
        return b"".join([self.digits.get(piece) or self.piece(piece) for piece in pieces])

    def one(self, word: str) -> bytes:
        return np.array(self.tool.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        if self.direct:
            plain = list(map(self.PLAIN.fullmatch, words))
            self.known.update((w, self.modelled(w)) for w, match in zip(words, plain, strict=True) if match)
            words = [w for w, match in zip(words, plain, strict=True) if not match]
        # The mark must be one token that no other word can hold.
        joined = [w for w in words if self.MARK not in w] if len(self.mark) == 1 else []
        for start in range(0, len(joined), JOINT):
            part = joined[start : start + JOINT]
            joint = self.tool.encode_batch_fast([f" {self.MARK} ".join(part)], add_special_tokens=False)[0]
            ids = np.array(joint.ids, dtype="<u4")
            cuts = 4 * np.flatnonzero(ids == self.mark[0])
            if len(cuts) != len(part) - 1:
                continue
            body = ids.tobytes()
            ends = [*cuts.tolist(), len(body)]
            self.known.update(zip(part, map(body.__getitem__, map(slice, [0, *(cuts + 4).tolist()], ends)), strict=True))
        for word in words:
            if word not in self.known:
                self.known[word] = self.one(word)

    def special(self, text: str) -> bool:
        if not any(head in text for head in self.heads):
            return False
        low = text.lower()
        return any(token in text or token.lower() in low for token in self.added)

    def cut(self, text: str) -> str:
        """The text with a space at every cut."""
        text = text.replace("\n", " ")
        if text.isascii() or not self.MARKED.search(text):
            text = text.lower() if text.isascii() else text.encode().lower().decode()
        if not self.IN_RUN.search(text if text.isascii() else unicodedata.normalize("NFC", text)):
            text = text.replace(", ", " , ").replace(". ", " . ")
        return text

    @staticmethod
    def parted(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct words of cut texts, the place of every word among these, and the bounds of each text's words."""
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        return words, coded.indices.to_numpy(), split.offsets.to_numpy()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Distinct words of all texts are found first, so that each is looked up once."""
        whole = {i: self.one(text) for i, text in enumerate(texts) if self.special(text)}
        words, place, edges = self.parted(["" if i in whole else self.cut(text) for i, text in enumerate(texts)])
        if len(self.known) > REMEMBERED:
            # All words of these texts are looked up below, so none of them may be missing then.
            self.known = {"": b""}
        bodies = list(map(self.known.get, words))
        new = [i for i, body in enumerate(bodies) if body is None]
        self.learn([words[i] for i in new])
        for i in new:
            bodies[i] = self.known[words[i]]
        ids = np.frombuffer(b"".join(bodies), dtype="<u4")
        sizes = np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies)) // 4
        starts = np.cumsum(sizes) - sizes
        # The ids of every word in a row: where its own begin, and on from there.
        many = sizes[place]
        ends = np.concatenate([[0], np.cumsum(many)])
        taken = np.repeat(starts[place] - ends[:-1], many)
        taken += np.arange(ends[-1])
        row = ids[taken].tobytes()
        bounds = (4 * ends[edges]).tolist()
        return [whole[i] if i in whole else row[bounds[i] : bounds[i + 1]] for i in range(len(texts))]


def portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and end of every run of rows with at most ``PORTION_BYTES`` of text, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PORTION_BYTES, side="right")))
        yield start, stop
        start = stop


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, as many together as have at most ``PORTION_BYTES`` of text: they come with few rows each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        own = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if held and size + own > PORTION_BYTES:
            joined = pa.concat_batches(held)
            held, size = [], 0
            yield joined
        held.append(batch)
        size += own
    if held:
        yield pa.concat_batches(held)


@functools.lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def tokenised(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """(doc_id, n_tokens, ids) of (doc_id, text), row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = word_tokens(path)
        end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        for batch in gathered(batches):
            for start, stop in portions(batch.column("text")):
                part = batch.slice(start, stop - start)
                bodies = [ids + end for ids in tool.encode(part.column("text").to_pylist())]
                counts = np.array([len(b) // 4 for b in bodies], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(bodies), dtype="<i4"))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(counts.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets), values),
                    ],
                    schema=TOKENS,
                )

    return docs.mapInArrow(run, SCHEMA_SQL)


def write_tokens(
    docs: DataFrame,
    folder: str,
    path: str,
    end_id: int | None = None,
    encoding: str = "dictionary",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write token files in ascending ``doc_id`` order (nulls first), rows of the same identifier in any number of files.

    A null text is empty and has the end id alone; repeated rows are written as often as they come;
    an empty table gives a folder with no rows.
    """
    # Rows of one identifier, or of none, needn't be in one file.
    numbered = documents(docs, id_col, text_col).withColumn("__place", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange("doc_id", "__place").sortWithinPartitions("doc_id", "__place").drop("__place")
    writer = (
        tokenised(ordered, path, end_id)
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.write-checksum.enabled", "true")
    )
    if encoding == "delta":
        writer = writer.option("parquet.enable.dictionary", "false").option("parquet.writer.version", "PARQUET_2_0")
    elif encoding != "dictionary":
        raise ValueError(encoding)
    writer.parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA_SQL).parquet(folder)


def start_positions(tokens: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``rows`` (file, row, doc_id, n_tokens and more; default: from the files) with their ``start``.

    Reads no token ids. Files are put in order of their identifiers; a file's rows are bounded by
    its range, and keep the order they are stored in.
    """
    meta = tokens.select(
        "doc_id",
        F.col("n_tokens").cast("bigint").alias("n_tokens"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    files = meta.groupBy("file").agg(
        F.sum("n_tokens").alias("total"),
        F.min("doc_id").alias("low"),
        F.max("doc_id").alias("high"),
    )
    # One row a file.
    before = Window.orderBy(F.col("high").asc_nulls_first(), F.col("low").asc_nulls_first(), "file").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = meta if rows is None else rows
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offsets, "file")
    return placed.withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


DIGESTS = pa.schema(
    [("doc_id", pa.int64()), ("file", pa.string()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
)


def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        values = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
        ends = ids.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        columns = [batch.column(c) for c in ("doc_id", "file", "row")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], schema=DIGESTS
        )


def token_digests(tokens: DataFrame) -> DataFrame:
    """Per row of the files: doc_id, start, n_tokens, ids_crc32, all from the ids that were read."""
    stored = tokens.select(
        "doc_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "ids"
    )
    sums = stored.mapInArrow(checksums, "doc_id bigint, file string, row bigint, n_tokens bigint, ids_crc32 bigint")
    return start_positions(tokens, sums).select("doc_id", "start", "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    spark = docs.sparkSession
    folder = scratch(spark, "token-files")
    write_tokens(docs, folder, path, end_id)
    return token_digests(read_tokens(spark, folder))
