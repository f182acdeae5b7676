"""Corpus preparation: language, copies, near copies, mixture and tokens, one stage after another.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns they got, whatever others there
are beside those of documents; an empty table goes through all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, exact_dedup, language, mixing, ngram_join, queries
from plumbline.llm.common import released, scratch


def told_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, by dictionaries of the labelled ones among them.

    Null and empty texts, and texts without letters, have no language and go; repeated rows are judged alike.
    Rows without identifier are judged, but nothing is learned from them. Where no document is labelled, all go.
    """
    return language.accepted(docs, queries.language_dictionaries(docs))


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts exactly one row: of the smallest identifier, and without one only if no row has any.

    Decided row by row, so of an identifier with several texts only the copies go, and of rows that repeat
    identifier and text one stays. Null and empty texts are equal.
    """
    return exact_dedup.without_copies(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest identifier (one without only if no row has any).

    Decided row by row: of an identifier with several texts only the near copy goes. Rows that repeat a text
    are linked, null and empty ones with nothing.
    """
    return ngram_join.one_of_each(docs)


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their rates say: never, once or several times; those without identifier once.

    Null and empty texts are taken as often as the rate of an empty text says. Repeated rows are taken alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.taken(docs, labels, queries.TARGETS, anchor="clean")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of them and of the bytes they decode to.

    One row for each row of ``docs``, repeated and without identifier as they come; null and empty texts have no ids.
    """
    found = bpe.encode_decode(docs, queries.RANKS, public_tokenizers.PATTERN)
    return found.select(
        "doc_id",
        bpe.token_count("ids").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language", told_language),
    ("exact_dedup", first_copies),
    ("ngram_join", one_of_near_copies),
    ("mixing", mixed_to_weights),
    ("bpe", token_ids),
]

#: Compression, naive Bayes and byte pair merges have no SQL form; tests compare with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage stores for itself is deleted when its output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        with released(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
