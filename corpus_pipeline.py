"""A training-corpus pipeline: each stage reads the table that the stage before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terraledger.llm import exact_dedup, minhash, packing, substring, toxicity
from terraledger.llm.queries import table, vocabulary
from terraledger.llm.scratch import materialize


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model scores below 0.5; it learns from ``labels`` that may be learnt.

    Null and empty texts score as a text without features, and stay; repeated
    rows share their fate; an empty table gives an empty one.
    """
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays.

    Null texts count as empty, so one of all null and empty ones stays; of
    repeated (doc_id, text) rows one does; an empty table gives an empty one.
    """
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links join, the one with the smallest doc_id stays.

    Null, empty and blank texts have no links and stay; repeated rows share
    their fate; an empty table gives an empty one.
    """
    return minhash.dedup(docs)


def spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences that a repeated run other than its first covers.

    All rows stay, null and empty texts as they are; repeated rows take nothing
    from each other; an empty table gives an empty one.
    """
    return substring.strip(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of at most 2048 tokens.

    A null or empty text is its end token alone; repeated rows are packed as
    often as they occur; an empty table gives no rows.
    """
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", nontoxic),
    ("exact dedup", exact),
    ("minhash near-dedup", near),
    ("substring dedup", spans),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; every stage but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
