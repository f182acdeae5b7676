"""Similarity join of documents on sets of word n-grams, by prefixes under several token orders.

Two sets of n_a and n_b tokens with Jaccard similarity of at least t share a token of their prefixes
(the first n - ceil(t n) + 1 tokens) under *every* order of all tokens. Three orders are used in
turn, each on what the ones before have left:

1. By a hash, but tokens in the lowest part of the hash range by frequency. Only that part of the
   tokens has to be counted. A document whose prefix holds none that occurs twice has no partner.
2. By frequency among the remaining documents, all tokens. Documents that share a token of their
   prefixes are candidates.
3. By frequency in powers of two, then by another hash: a candidate pair must share here, too.

Once both sizes are known, the prefixes of orders 2 and 3 shrink: a pair must share o = ceil(t (n_a +
n_b) / (1 + t)) tokens, so the first n - o + 1 of each are enough. Exact set comparison follows.

Not all pairs of a group of near copies are looked at: first every document is compared with one
central document for each of its prefix tokens, and the links found are joined to components. Then
all pairs in *different* components that share a prefix token are compared. A pair left out has
either been ruled out by a filter or lies in one component already, so the components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import (
    MIX_2,
    ROW,
    Chunks,
    Rows,
    binaries,
    documents,
    mixed,
    signed,
    staged,
    with_row_key,
    without_rows,
    word_hashes,
)
from plumbline.llm.components import components

#: Part of the hash range whose tokens order 1 counts; prefixes take a quarter of the tokens.
COUNTED = 0.36
#: Size of the bitmap (4 MB) that sifts texts before sets are made of them.
FILTER_BITS = 1 << 25
STEPS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def shingle_set(words: list[bytes], n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word n-grams; of a shorter text, of the whole of it."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = word_hashes(words, len(words))
    size = min(n, len(words))
    total = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total = mixed(total * STEPS[0] + hashes[i : i + len(total)])
    return np.unique(total)


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def digest_of(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


HEADER = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary())])


def header_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = Rows(HEADER)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), binaries(batch.column("text")), strict=True):
                words = text.lower().split()
                out.add(doc_id, len(shingle_set(words, n)), digest_of(words) if words else None)
            yield from out.take()

    return run


FIRST = pa.schema([("token", pa.int64()), ("doc_id", pa.int64()), ("slack", pa.int32())])


def first_order_rows(n: int, percent: int, counted: float):
    """Tokens of order 1. ``slack``: how many may occur elsewhere before the prefix holds one."""
    limit = np.uint64(min(int(counted * 2**64), 2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Chunks(FIRST)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), binaries(batch.column("text")), strict=True):
                tokens = shingle_set(text.lower().split(), n)
                if len(tokens):
                    prefix = prefix_length(len(tokens), percent)
                    own = tokens[: max(prefix, int(np.searchsorted(tokens, limit)))]
                    out.add(
                        signed(own >> np.uint64(16)),  # 48 bits: a collision can only add candidates
                        np.full(len(own), doc_id, dtype=np.int64),
                        np.full(len(own), len(own) - prefix, dtype=np.int32),
                    )
                if out.full():
                    yield from out.take()
        yield from out.take()

    return run


def bitmap(ids: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, set at the hash places of ``ids``: its size doesn't depend on the data."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    words = ids.select(place.alias("place")).groupBy(F.expr("place div 64").alias("word"))
    rows = words.agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out


SETS = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int32()), ("tokens", pa.binary())])


def set_rows(n: int, wanted):
    """Sets of the documents whose ``place`` is in the broadcast bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(SETS)
        bits = wanted.value
        for batch in batches:
            place = batch.column("place").to_numpy()
            batch = batch.filter(pa.array((bits[place >> 6] >> (place & 63) & 1).astype(bool)))
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), binaries(batch.column("text")), strict=True):
                words = text.lower().split()
                if words:
                    tokens = shingle_set(words, n)
                    out.add(doc_id, digest_of(words), len(tokens), tokens.tobytes(), size=8 * len(tokens))
                if out.full():
                    yield from out.take()
        yield from out.take()

    return run


TOKENS = pa.schema([("token", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32())])


def token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Chunks(TOKENS)
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "n", "tokens"))
        for doc_id, n, tokens in zip(*columns, strict=True):
            own = np.frombuffer(tokens, dtype=np.int64)
            out.add(own, np.full(len(own), doc_id, dtype=np.int64), np.full(len(own), n, dtype=np.int32))
            if out.full():
                yield from out.take()
    yield from out.take()


PREFIXES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n", pa.int32()),
        ("unique", pa.int32()),
        ("second", pa.list_(pa.int64())),
        ("third", pa.binary()),
    ]
)
PREFIXES_SQL = "doc_id bigint, n int, unique int, second array<bigint>, third binary"


def prefix_rows(percent: int):
    """Prefixes under orders 2 and 3 from a document's tokens that others have, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(PREFIXES)
        for batch in batches:
            lists = batch.column("shared")
            tokens, counts = (lists.values.field(c).to_numpy(zero_copy_only=False) for c in ("token", "df"))
            ends = lists.offsets.to_pylist()
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "n"))
            for doc_id, n, start, end in zip(*columns, ends[:-1], ends[1:], strict=True):
                # Rows that repeat a document list its tokens again.
                token, at = np.unique(tokens[start:end], return_index=True)
                often = counts[start:end][at]
                count = prefix_length(n, percent) - (n - len(token))
                if count <= 0:
                    continue
                bits = token.view(np.uint64)
                second = token[np.lexsort((bits, often))[:count]]
                third = token[np.lexsort((mixed(bits ^ MIX_2), np.frexp(often)[1]))[:count]]
                out.add(doc_id, n, n - len(token), second.tolist(), third.tobytes(), size=20 * count)
                if out.full():
                    yield from out.take()
        yield from out.take()

    return run


VERIFIED = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def needed(n_a: int, n_b: int, percent: int) -> int:
    """Least number of tokens that two sets as similar as asked share."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def verified_rows(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = Rows(VERIFIED)
            names = ("a", "b", "unique_a", "unique_b", "third_a", "third_b", "tokens_a", "tokens_b")
            for a, b, unique_a, unique_b, *parts in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                third_a, third_b, one, other = (np.frombuffer(x, dtype=np.uint64) for x in parts)
                least = needed(len(one), len(other), percent)
                third_a = third_a[: max(0, len(one) - least + 1 - unique_a)]
                third_b = third_b[: max(0, len(other) - least + 1 - unique_b)]
                if not common(third_a, np.sort(third_b)):
                    continue
                shared = common(one, other)
                if 100 * shared >= percent * (len(one) + len(other) - shared):
                    out.add(a, b)
            yield from out.take()

    return run


def common(one: np.ndarray, other: np.ndarray) -> int:
    """How many values of a set another, sorted one holds."""
    at = np.searchsorted(other, one)
    at[at == len(other)] = 0
    return int(np.count_nonzero(other[at] == one)) if len(other) else 0


def verified(pairs: DataFrame, prefixes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share a token under order 3 and are as similar as asked."""
    for side in "ab":
        own = prefixes.select(
            F.col("doc_id").alias(side), F.col("unique").alias(f"unique_{side}"), F.col("third").alias(f"third_{side}")
        )
        whole = sets.select(F.col("doc_id").alias(side), F.col("tokens").alias(f"tokens_{side}"))
        pairs = pairs.join(own, side).join(whole, side)
    return pairs.mapInArrow(verified_rows(percent), "a bigint, b bigint")


def candidates(
    docs: DataFrame, header: DataFrame, n: int, percent: int, counted: float
) -> tuple[DataFrame, DataFrame]:
    """Of what orders 1 and 2 leave: prefixes (doc_id, n, unique, second, third) and sets (doc_id, tokens)."""
    tokens = docs.filter("doc_id is not null").mapInArrow(
        first_order_rows(n, percent, counted), "token bigint, doc_id bigint, slack int"
    )
    again = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("token")
    left = (
        tokens.join(again, "token", "left_semi")
        .groupBy("doc_id", "slack")
        .agg(F.count(F.lit(1)).alias("shared"))
        .filter("shared > slack")
        .select("doc_id")
        .distinct()
    )
    # One document stands for all with its word sequence.
    first = (
        header.filter("digest is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("digest").alias("digest"))
        .groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id"))
    )
    live = staged(first.join(left, "doc_id", "left_semi").select("doc_id", "digest"), "live")
    # The bitmap spares most texts the way to the join that decides, as long as it isn't full.
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(live))
    placed = docs.filter("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("place"))
    made = placed.mapInArrow(set_rows(n, wanted), "doc_id bigint, digest binary, n int, tokens binary")
    # Of rows that repeat an identifier only those of the chosen text take part.
    sets = staged(made.join(live, ["doc_id", "digest"], "left_semi").drop("digest"), "sets")
    rows = sets.mapInArrow(token_rows, "token bigint, doc_id bigint, n int")
    often = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    prefixes = (
        rows.join(often, "token")
        .groupBy("doc_id", "n")
        .agg(F.collect_list(F.struct("token", "df")).alias("shared"))
        .mapInArrow(prefix_rows(percent), PREFIXES_SQL)
    )
    return staged(prefixes, "prefixes"), sets


def in_buckets(labelled: DataFrame) -> DataFrame:
    """A row for each prefix token under order 2, with its place among all tokens of the document."""
    placed = labelled.select("doc_id", "n", "unique", "label", F.posexplode("second").alias("place", "token"))
    return placed.withColumn("place", F.col("place") + F.col("unique"))


def may_be_similar(percent: int):
    """Whether two documents (n, place; n_x, place_x) can be, if this is their first shared token."""
    least = F.ceil(percent * (F.col("n") + F.col("n_x")) / (100.0 + percent))
    sized = 100 * F.least("n", "n_x") >= percent * F.greatest("n", "n_x")
    return sized & (F.col("place") <= F.col("n") - least) & (F.col("place_x") <= F.col("n_x") - least)


def similar_documents(
    docs: DataFrame,
    n: int = 5,
    percent: int = 75,
    counted: float = COUNTED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id reachable by links, itself included).

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text with fewer than ``n``
    words has its whole sequence as the only token, one without words (or null) has none and no
    links. Rows that repeat an identifier are one vertex: the text of greatest digest is compared,
    and equal texts of others count as its copies. Rows without identifier are not linked.
    Tokens are compared by 64-bit hashes, word sequences of copies by 128-bit ones.
    """
    texts = documents(docs, id_col, text_col)
    header = staged(texts.mapInArrow(header_rows(n), "doc_id bigint, n_shingles bigint, digest binary"), "header")
    prefixes, sets = candidates(texts, header, n, percent, counted)

    labelled = prefixes.withColumn("label", F.col("doc_id"))
    # The central document has the least share of tokens of its own.
    centre = F.min(F.struct((F.col("unique") / F.col("n")).alias("own"), "doc_id", "n", "place"))
    centres = staged(
        in_buckets(labelled).groupBy("token").agg(centre.alias("x"), F.count(F.lit(1)).alias("df")).filter("df > 1"), "centres"
    )
    around = (
        in_buckets(labelled)
        .join(centres.select("token", F.col("x.doc_id").alias("x"), F.col("x.n").alias("n_x"), F.col("x.place").alias("place_x")), "token")
        .filter(F.col("doc_id") != F.col("x"))
        .filter(may_be_similar(percent))
        .select(F.least("doc_id", "x").alias("a"), F.greatest("doc_id", "x").alias("b"))
    )
    pairs = staged(around.distinct(), "centre-pairs")
    links = staged(verified(pairs, prefixes, sets, percent), "centre-links")

    labels = components(links)
    labelled = staged(
        prefixes.drop("third")
        .join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .withColumn("label", F.coalesce("label", "doc_id")),
        "labelled",
    )
    main = centres.join(
        labelled.select(F.col("doc_id").alias("centre"), F.col("label").alias("main")), F.col("x.doc_id") == F.col("centre")
    ).select("token", "main")
    members = in_buckets(labelled).join(main, "token")
    # Pairs of different components have a member outside the centre's: the smaller side of the join.
    outside = members.filter("label <> main").select(
        "token",
        F.col("doc_id").alias("x"),
        F.col("n").alias("n_x"),
        F.col("place").alias("place_x"),
        F.col("label").alias("label_x"),
    )
    different = (F.col("label") != F.col("label_x")) & ((F.col("label") == F.col("main")) | (F.col("doc_id") < F.col("x")))
    others = (
        members.join(outside, "token")
        .filter(different & may_be_similar(percent))
        .select(F.least("doc_id", "x").alias("a"), F.greatest("doc_id", "x").alias("b"))
        .distinct()
    )
    further = verified(staged(others.join(pairs, ["a", "b"], "left_anti"), "other-pairs"), prefixes, sets, percent)

    vertex = (
        header.filter("digest is not null and doc_id is not null").groupBy("doc_id").agg(F.max("digest").alias("digest"))
    )
    first = vertex.groupBy("digest").agg(F.min("doc_id").alias("b"))
    copies = header.filter("digest is not null and doc_id is not null").join(first, "digest").select(
        F.col("doc_id").alias("a"), "b"
    )
    found = components(links.unionByName(further).unionByName(copies))
    return header.join(found, header.doc_id == found.id, "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each group of linked rows the one of least doc_id (nulls last), with all its columns, and all other rows.

    Every row is a vertex of its own, so rows that repeat an identifier, or have none, are told apart;
    null and empty texts are linked with nothing and stay.
    """
    keyed = with_row_key(docs)
    found = staged(similar_documents(keyed, id_col=ROW).filter("n_shingles > 0").select(F.col("doc_id").alias(ROW), "component_id"), "groups")
    several = found.filter(f"{ROW} <> component_id").select("component_id").distinct()
    linked = found.join(several, "component_id", "left_semi").join(keyed.select(ROW, "doc_id"), ROW)
    # Combined before it is shuffled, so a group of any size is one row a task.
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(ROW).alias("kept"))
    first = linked.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.kept").alias(ROW))
    gone = staged(linked.select(ROW).join(first, ROW, "left_anti"), "near-copies")
    return without_rows(keyed, gone)


#: Documents of one token that are compared in one task; larger buckets are dealt out in pairs of parts.
TOGETHER = 512


def pairs_in_buckets(prefixes: DataFrame, percent: int, together: int = TOGETHER) -> DataFrame:
    """Distinct pairs (a < b) that share a prefix token and may be similar.

    A bucket of k documents falls into ceil(k / ``together``) parts, and each pair of parts is a key
    of its own, so that no task holds more than two parts of a token.
    """
    buckets = in_buckets(prefixes.withColumn("label", F.col("doc_id"))).select("token", "doc_id", "n", "place")
    often = buckets.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / F.lit(together)).alias("parts"), F.count(F.lit(1)).alias("df"))
    dealt = buckets.join(often.filter("df > 1").select("token", "parts"), "token").withColumn(
        "part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    )
    keyed = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    keyed = keyed.select(
        "token", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "doc_id", "n", "place"
    )
    left = keyed.filter("part = low")
    right = keyed.filter("part = high").select(
        "token", "low", "high", F.col("doc_id").alias("x"), F.col("n").alias("n_x"), F.col("place").alias("place_x")
    )
    # Inside one part each pair comes in both orders, across two parts in one.
    return (
        left.join(right, ["token", "low", "high"])
        .filter(((F.col("low") < F.col("high")) | (F.col("doc_id") < F.col("x"))) & may_be_similar(percent))
        .select(F.least("doc_id", "x").alias("a"), F.greatest("doc_id", "x").alias("b"))
        .distinct()
    )


def link_counts(
    docs: DataFrame,
    n: int = 5,
    percent: int = 75,
    counted: float = COUNTED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per identifier: doc_id, n_links, the number of other identifiers linked to it.

    The links are those of ``similar_documents``, all of them: every pair of different texts that may
    be similar is verified, and a text counts as often as identifiers have it. The pairs of a group of
    near copies with different texts are as many as its square.
    """
    texts = documents(docs, id_col, text_col)
    header = staged(texts.mapInArrow(header_rows(n), "doc_id bigint, n_shingles bigint, digest binary"), "header")
    prefixes, sets = candidates(texts, header, n, percent, counted)
    pairs = staged(pairs_in_buckets(prefixes, percent), "all-pairs")
    links = staged(verified(pairs, prefixes, sets, percent), "all-links")

    vertex = header.filter("doc_id is not null").groupBy("doc_id").agg(F.max("digest").alias("digest"))
    # A text is named by the least identifier that has it, as in ``candidates``.
    named = staged(
        vertex.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("copies")),
        "texts",
    )
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = (
        ways.join(named.select(F.col("a").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    )
    counts = named.join(others, "a", "left").select("digest", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return vertex.join(counts, "digest", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
