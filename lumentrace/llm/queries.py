"""One query per operator over its whole table, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumentrace.llm import (bpe, chat, fingerprints, licenses, mixing, ngram_join, periodic, phrases, quality, sharding, toxicity, url_filters,
                            vectors)
from lumentrace.llm.oracles import ORACLES

#: The rank file and the pattern of the byte-level vocabulary, found where the vocabulary files are installed.
VOCABULARY = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op1_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.document_fingerprints(table(spark, sf, "documents"))


def op2_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf, "documents"), *vocabulary())


def op3_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return url_filters.judged(table(spark, sf, "pages"))


def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.taken(table(spark, sf, "documents"))


def op5_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shards_of(table(spark, sf, "documents"))


def op6_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.licenses(licenses.as_files(table(spark, sf, "documents")))


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.severities(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op8_chat(spark: SparkSession, sf: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return chat.conversation_digests(rows.unionByName(added))


def op9_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf, "documents"), 3, 90)


def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.verdicts(table(spark, sf, "documents"))


def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return periodic.run_digests(table(spark, sf, "documents"))


def op12_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


def op13_vector_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.vector_components(table(spark, sf, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_fingerprints, op2_byte_bpe, op3_url_filters, op4_mixing, op5_sharding, op6_licenses, op7_toxicity, op8_chat,
              op9_ngram_join, op10_quality, op11_periodic_runs, op12_phrases, op13_vector_dedup)
}


def load() -> tuple[dict, dict]:
    return dict(QUERIES), dict(ORACLES)
