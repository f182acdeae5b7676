"""Document fingerprints: a Merkle tree over blocks, paragraphs and sections, in SQL functions.

A paragraph is a line; its leaves are blocks of ``BLOCK`` characters. A paragraph's hash is that of
its leaves' hashes, a section's that of ``SECTION`` paragraphs, the root that of the sections. Equal
roots mean equal texts; where roots differ, differing sections and in them differing paragraphs show
where texts differ. The fingerprint is the root with short hashes of the leaves, which give the
likeness of two texts without the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import documents, staged

BLOCK = 24
SECTION = 8
#: Hexadecimal digits of a leaf in the fingerprint.
DIGITS = 6
#: Join key of rows without identifier.
NO_ID = -(2**63)


def leaf_hashes(text: Column) -> Column:
    """Array of paragraphs, each the array of its leaves' hashes."""
    block = F.lit(f"(?s).{{1,{BLOCK}}}")
    return F.transform(
        F.split(text, "\n"),
        lambda line: F.transform(F.regexp_extract_all(line, block, F.lit(0)), lambda leaf: F.xxhash64(leaf)),
    )


def sections(paragraphs: Column) -> Column:
    groups = F.sequence(F.lit(0), F.floor((F.size(paragraphs) - 1) / SECTION).cast("int"))
    return F.transform(groups, lambda i: F.xxhash64(F.slice(paragraphs, i * SECTION + 1, SECTION)))


def root(section_hashes: Column, n_chars: Column) -> Column:
    return F.sha2(F.concat_ws(",", section_hashes.cast("array<string>"), n_chars.cast("string")), 256)


def with_fingerprint(df: DataFrame, text_col: str, name: str, parts: bool = False) -> DataFrame:
    """``df`` with the fingerprint of a text column; ``parts`` adds <name>_paragraphs and <name>_sections."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    leaves, paragraphs, groups = f"{name}_leaves", f"{name}_paragraphs", f"{name}_sections"
    short = F.transform(
        F.flatten(F.col(leaves)),
        lambda h: F.lpad(F.hex(h.bitwiseAND(F.lit(16**DIGITS - 1))), DIGITS, "0"),
    )
    made = (
        df.withColumn(leaves, leaf_hashes(text))
        .withColumn(paragraphs, F.transform(F.col(leaves), lambda p: F.xxhash64(p)))
        .withColumn(groups, sections(F.col(paragraphs)))
        .withColumn(name, F.concat_ws(":", root(F.col(groups), F.length(text)), F.array_join(short, "")))
        .drop(leaves)
    )
    return made if parts else made.drop(paragraphs, groups)


def fingerprint_leaves(fingerprint: Column) -> Column:
    """Distinct short leaf hashes of a fingerprint."""
    body = F.substring_index(fingerprint, ":", -1)
    return F.array_distinct(F.regexp_extract_all(body, F.lit(f".{{{DIGITS}}}"), F.lit(0)))


def likeness(one: Column, other: Column) -> Column:
    """0 to 1: shared leaves of two fingerprints as a part of both (Dice); 1 for equal roots."""
    a, b = fingerprint_leaves(one), fingerprint_leaves(other)
    shared = 2.0 * F.size(F.array_intersect(a, b)) / F.greatest(F.size(a) + F.size(b), F.lit(1))
    return F.when(F.substring_index(one, ":", 1) == F.substring_index(other, ":", 1), F.lit(1.0)).otherwise(shared)


def changed_paragraphs(one: Column, other: Column) -> Column:
    """Positions (from 0) of the paragraph hashes of ``one`` that differ at that place in ``other``."""
    places = F.sequence(F.lit(0), F.size(one) - 1)
    return F.filter(places, lambda i: ~F.get(one, i).eqNullSafe(F.get(other, i)))


def next_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id): the next smaller identifier; after the smallest, the largest.

    Identifiers are range-partitioned and ordered inside their ranges; one row a range links them.
    """
    ids = docs.filter("doc_id is not null").select("doc_id").distinct().repartitionByRange("doc_id")
    ranged = staged(ids.withColumn("part", F.spark_partition_id()), "ranges")
    tops = ranged.groupBy("part").agg(F.max("doc_id").alias("top"))
    by_part = Window.orderBy("part")  # one row a range
    whole = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = tops.select("part", F.coalesce(F.lag("top").over(by_part), F.max("top").over(whole)).alias("below"))
    inside = F.lead("doc_id").over(Window.partitionBy("part").orderBy(F.col("doc_id").desc()))
    return (
        ranged.withColumn("inside", inside)
        .join(F.broadcast(before), "part")
        .select("doc_id", F.coalesce("inside", "below").alias("next_id"))
    )


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited form and of the next document, with their likeness.

    Edited: the last third of the characters replaced by as many (or all) of the first of the next
    document in descending ``doc_id`` (after the last: the first). Per row: doc_id, n_chars, edited,
    fingerprint, edited_fingerprint, next_fingerprint, near_edited, near_next. A null text is empty.
    Of rows that repeat an identifier the least text is the next document of others. A row without
    identifier is nobody's next document, and its own is empty.
    """
    plain = documents(docs, id_col, text_col)
    # Both joins take the same columns by the same key, so texts are shuffled once.
    texts = plain.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "text")
    lengths = plain.groupBy("doc_id").agg(F.max(F.length("text")).alias("n")).filter("doc_id is not null")
    wanted = staged(
        next_ids(plain)
        .join(lengths, "doc_id")
        .select(F.col("doc_id").alias("target"), F.col("next_id").alias("source"), F.expr("n div 3").alias("k")),
        "next",
    )
    sent = (
        with_fingerprint(texts.join(wanted, texts.key == wanted.source), "text", "next_fingerprint")
        .select("target", F.expr("left(text, k)").alias("head"), "next_fingerprint")
        .groupBy("target")
        .agg(F.min(F.struct("head", "next_fingerprint")).alias("next"))
    )
    empty = with_fingerprint(docs.sparkSession.range(1).select(F.lit("").alias("text")), "text", "f").first()["f"]
    nothing = F.struct(F.lit("").alias("head"), F.lit(empty).alias("next_fingerprint"))
    every = texts.join(sent, texts.key == sent.target, "left").select(
        F.nullif("key", F.lit(NO_ID)).alias("doc_id"), "text", F.coalesce("next", nothing).alias("next")
    )
    joined = with_fingerprint(every, "text", "fingerprint").select(
        "doc_id",
        "fingerprint",
        F.length("text").cast("bigint").alias("n_chars"),
        F.col("next.next_fingerprint").alias("next_fingerprint"),
        F.expr("concat(left(text, length(text) - length(text) div 3), left(next.head, length(text) div 3))").alias("edited"),
    )
    made = with_fingerprint(joined, "edited", "edited_fingerprint")
    return made.withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint"))).withColumn(
        "near_next", likeness(F.col("fingerprint"), F.col("next_fingerprint"))
    )
