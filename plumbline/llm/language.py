"""Language identification by compression.

Each language has a zstandard raw-content dictionary of sample text. A text is compressed block by
block with every dictionary, and the language of the smallest total is chosen; ``score`` is the
margin to the next one. Only letters count: everything else is a space, capitals are lowered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Rows, small_batches

UNKNOWN = "und"
OTHER = re.compile(r"[\W\d_]+")
BLOCK = 4096
#: Bounds of the labelled sample, for each language.
SAMPLE_ROWS = 400
SAMPLE_CHARS = 1000
DICTIONARY_BYTES = 1 << 17
#: A language is accepted if the next one needs this share more bytes, at any length. Fitted on held-out
#: documents, which lead by 0.08 or more unless they are a few words, against random letters.
MARGIN = 0.02
#: Bits of the hash that one count of labelled rows tells apart, and rows of a range that aren't counted again.
BITS = 12
NEAR = 4096
#: Matches below this length say little about a language and their offsets cost more than they save.
MIN_MATCH = 5


def letters(text: str) -> str:
    return OTHER.sub(" ", text.lower()).strip()


def by_language(values: dict[str, int]) -> Column:
    """The value of a row's language; null for others."""
    pairs = [F.lit(x) for lang, value in values.items() for x in (lang, value)]
    return F.try_element_at(F.create_map(*pairs), F.col("lang"))


def cut_offs(sample: DataFrame, rows: int) -> tuple[dict[str, int], dict[str, int]]:
    """By language: a hash that at least ``rows`` rows are not above (all, if there are fewer), and the number of rows.

    Rows are counted by the first bits of their hash, and again by the next ones inside the range that holds the
    last row wanted while it has many, so only ``NEAR`` rows more than wanted lie below (and those of one hash).
    """
    cuts: dict[str, int] = {}
    counts: dict[str, int] = {}
    wanted: dict[str, int] = {}
    shift, frame = 64 - BITS, sample
    while True:
        found: dict[str, list[tuple[int, int]]] = {}
        for row in frame.groupBy("lang", F.shiftright("hash", shift).alias("range")).count().collect():
            found.setdefault(row.lang, []).append((row.range, row["count"]))
        again: dict[str, int] = {}
        for lang, ranges in found.items():
            counts.setdefault(lang, sum(n for _, n in ranges))
            cuts[lang] = 2**63 - 1
            left = wanted.get(lang, rows)
            for place, n in sorted(ranges):
                if n >= left:
                    cuts[lang] = ((place + 1) << shift) - 1
                    if n > NEAR and shift:
                        again[lang], wanted[lang] = place, left
                    break
                left -= n
        if not again:
            return cuts, counts
        frame = sample.filter(F.shiftright("hash", shift) == by_language(again))
        shift = max(0, shift - BITS)


def fit_dictionaries(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows: int = SAMPLE_ROWS,
    chars: int = SAMPLE_CHARS,
) -> dict[str, bytes]:
    """Dictionary of each language, from at most ``rows`` texts of at most ``chars`` characters.

    The texts are those of least identifier hash. Rows without language or letters are left out. The
    driver holds ``rows * chars`` characters for each language.
    """
    sample = labelled.select(
        F.col(f"`{lang_col}`").alias("lang"),
        F.col(f"`{id_col}`").cast("string").alias("id"),
        F.substring(F.col(f"`{text_col}`"), 1, chars).alias("text"),
    ).filter("lang is not null and text rlike '\\\\p{L}'").withColumn("hash", F.xxhash64("id"))
    cuts, counts = cut_offs(sample, rows)
    if not cuts:
        return {}
    order = Window.partitionBy("lang").orderBy("hash", "id", "text")
    near = sample.filter(F.col("hash") <= by_language(cuts))
    picked = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= rows)
    parts: dict[str, list[tuple[int, str]]] = {}
    for row in picked.select("lang", "place", "text").collect():
        parts.setdefault(row.lang, []).append((row.place, row.text))
    return {
        lang: " ".join(letters(text) for _, text in sorted(parts[lang])).encode()[-DICTIONARY_BYTES:]
        for lang in sorted(parts, key=lambda lang: (-counts[lang], lang))
    }


class Compressors:
    """``dictionaries``: languages in order of preference where sizes are equal."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = list(dictionaries)
        self.tools = []
        for body in dictionaries.values():
            parameters = zstandard.ZstdCompressionParameters.from_level(
                3,
                source_size=BLOCK,
                dict_size=len(body),
                strategy=zstandard.STRATEGY_LAZY2,
                min_match=MIN_MATCH,
                write_content_size=False,
                write_checksum=False,
                write_dict_id=False,
            )
            raw = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=parameters)
            self.tools.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=parameters))

    def sizes(self, body: bytes) -> list[int]:
        blocks = [body[i : i + BLOCK] for i in range(0, len(body), BLOCK)]
        return [sum(len(tool.compress(block)) for block in blocks) for tool in self.tools]

    def ranked(self, text: str | None) -> list[tuple[int, int]]:
        body = letters(text or "").encode()
        if not body:
            return []
        # Spaces around a short text let its first and last word match whole words, too.
        return sorted((size, place) for place, size in enumerate(self.sizes(b" " + body + b" ")))

    def judged(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """Language, score, and whether it is told: not by a tie, and by the same share of bytes at any length."""
        ranked = self.ranked(text)
        if not ranked:
            return UNKNOWN, 0.0, False
        best = self.languages[ranked[0][1]]
        if len(ranked) == 1:
            return best, 1.0, True
        lead = ranked[1][0] - ranked[0][0]
        return best, 1.0 - ranked[0][0] / ranked[1][0], lead > 0 and lead >= margin * ranked[0][0]

    def told(self, text: str | None, margin: float) -> bool:
        return self.judged(text, margin)[2]


PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("told", pa.bool_())])


def predict_language(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    id_col: str = "doc_id",
    text_col: str = "text",
    margin: float = MARGIN,
) -> DataFrame:
    """Per row: doc_id, lang_pred, score (0 to 1: how much smaller than with the next language), told (``accepted``).

    ``und`` with score 0, not told, if the text is null, has no letter or no language has been learned. Ties
    go to the language with more labelled documents, with score 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Compressors(dictionaries)
        for batch in batches:
            out = Rows(PREDICTED)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                out.add(doc_id, *tools.judged(text.as_py(), margin))
            yield from out.take()

    small_batches(docs.sparkSession)
    picked = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, lang_pred string, score double, told boolean")


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows, whole and with all their columns, whose language is told by at least ``margin``."""
    small_batches(docs.sparkSession)
    position = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Compressors(dictionaries)
        for batch in batches:
            yield batch.filter(pa.array([tools.told(t.as_py(), margin) for t in batch.column(position)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
