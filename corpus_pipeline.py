"""A training corpus from raw documents: rules, toxicity, near duplicates, mixture, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumentrace.llm import bpe, mixing, ngram_join, quality, toxicity
from lumentrace.llm.common import released, written
from lumentrace.llm.queries import table, vocabulary

#: Near duplicates of the pipeline: five-word shingles at a similarity of 0.8.
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host does."""
    return quality.kept_documents(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low expected severity; the model is fitted on the labelled ones among the raw documents."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id.

    Of rows that share that doc_id one stays; a document without shingles is a group of its own.
    """
    return ngram_join.first_of_groups(docs, SHINGLE, PERCENT)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The parts of documents that the mix takes, as often as it takes them."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every part, and the digest of the bytes they decode to."""
    return bpe.round_trip(docs, *vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mixture),
    ("byte_bpe", token_ids),
]

#: A fitted model and pseudorandom draws have no SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    last = None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
        if last is not None:
            released(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
