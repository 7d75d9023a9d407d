import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, a repeated id, and columns with names that operators use."""
    long_text = " ".join(f"w{i % 977}x{i // 3}" for i in range(60_000))
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 4
    rows = [
        (1, base + "one", "en", "a", 5), (2, base + "one", "en", "a", 5), (2, base + "one", "en", "a", 5),
        (3, None, "en", "a", None), (4, "", None, None, 0), (5, " \t\n\x0b\x0c\r ", "en", "b", 7), (6, "word", "en", "b", 4),
        (7, "two words", "en", "b", 9), (8, long_text, "en", "a", None), (9, base + "two", "fr", None, 1),
        (None, "a text without an id that goes on for some words more than twenty so that the rule for short ones is met here", "en", "c", 1),
        (10, "same id first", "en", "c", 1), (10, "same id second", "en", "c", 1), (11, "é🙂 中文 ﻿x <|end|> <\\|turn|>   y", "xx", "é", 3),
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    from pyspark.sql import functions as F

    clash = {c: F.lit("clash") for c in ("size", "shard", "node", "key", "n_words", "block", "sid", "word", "label", "n", "u", "root", "packed", "slot", "start", "rate")}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
