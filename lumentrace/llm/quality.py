"""Document quality rules with host verdicts: failures by host, shrunk by an empirical beta prior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrace.functions.arrays import let
from lumentrace.llm.common import join_facts, text_or_empty, words, written

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A host goes when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
SYMBOLS = r"[#*$%&|<>]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _windows(hashes: Column) -> Column:
    """Hash of every run of eight word hashes, by doubling: 2, 4, then 8 words."""

    def paired(a: Column, step: int) -> Column:
        return F.zip_with(a, F.slice(a, F.lit(step + 1), F.size(a)), lambda x, y: F.xxhash64(x, y))

    two_four_eight = let(hashes, lambda a: let(paired(a, 1), lambda b: let(paired(b, 2), lambda c: paired(c, 4))))
    return let(two_four_eight, lambda w: F.slice(w, F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))))


def _covered(windows: Column) -> Column:
    """Words inside windows that occur at least twice; each word counts once."""

    def marked(ordered: Column) -> Column:
        same = lambda i, j: F.get(ordered, i)["h"] == F.get(ordered, j)["h"]
        twice = F.filter(
            ordered, lambda e, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False))
        )
        starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            starts,
            zero,
            lambda acc, p: F.struct(
                (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")
            ),
        )["n"]

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(pairs, marked)).otherwise(F.lit(0))


def _word_measures(text: Column) -> Column:
    def of(found: Column) -> Column:
        hashes = F.transform(found, lambda w: F.xxhash64(w))
        return F.struct(
            F.size(found).cast("long").alias("n"), let(_windows(hashes), _covered).cast("long").alias("r"),
            F.char_length(F.array_join(found, "")).cast("long").alias("c"),
        )

    return let(words(text), of)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and one struct ``__q`` with the measures of its text (null: no text).

    Windows are told apart by 64-bit hashes of their eight words.
    """
    t = text_or_empty(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = docs.withColumn("__w", _word_measures(t))
    n, repeated = F.col("__w.n"), F.col("__w.r")
    return found.withColumn(
        "__q",
        F.struct(
            n.alias("n_words"),
            F.col("__w.c").alias("word_chars"),
            (F.char_length(t) - F.char_length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
            repeated.alias("n_repeat_words"),
            ((n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)).alias("base_failed"),
        ),
    ).drop("__w")


def host_rates(scored: DataFrame, host: str) -> DataFrame:
    """One row per host: documents, failures, and the failure rate shrunk to the common one (from a written table of counts).

    The beta prior comes from the mean and variance of the hosts' own rates (method of moments). Where
    hosts do not differ (variance 0, or one host) the prior outweighs every host; null is a host of its own.
    """
    counts = written(scored.groupBy(F.col(host).alias("__host")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("__q.base_failed").cast("long")).alias("failed")
    ), "counts")
    rate = F.col("failed") / F.col("n")
    mean, spread = counts.agg(F.avg(rate)).scalar(), counts.agg(F.coalesce(F.var_pop(rate), F.lit(0.0))).scalar()
    room = mean * (1 - mean)
    strength = F.when(spread > room / 1e6, F.greatest(room / spread - 1, F.lit(1.0))).otherwise(F.lit(1e6))
    return counts.withColumn("rate", (F.col("failed") + mean * strength) / (F.col("n") + strength))


def judged(scored: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Rows of :func:`measured` with ``__kept``: the base rules and the host's verdict.

    A document stays when it passes the base rules and its host's shrunk failure rate is at most
    ``max_rate``. Null or empty text has no words and fails. Rows are judged one by one, so repeated rows
    and repeated ids get equal verdicts; an empty table gives an empty result; other columns pass through
    (names starting with ``__`` are reserved). ``scored`` is read twice, for the hosts and for the rows.
    """
    bad = written(host_rates(scored, host).filter(F.col("rate") > max_rate).select("__host"), "hosts")
    rejected = bad.select(
        F.coalesce("__host", F.lit("")).alias("__h"), F.isnull("__host").alias("__none"), F.lit(True).alias("__bad")
    )
    keyed = scored.withColumns({"__h": F.coalesce(F.col(host), F.lit("")), "__none": F.isnull(F.col(host))})
    joined = join_facts(keyed, rejected, rejected.count(), ["__h", "__none"])
    kept = ~F.col("__q.base_failed") & F.isnull("__bad")
    return joined.withColumn("__kept", kept).select(*scored.columns, "__kept")


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the measures and ``kept``, one row per document; other columns are not read."""
    scored = written(measured(docs.select("doc_id", "source", "text")).drop("text"), "quality")
    return judged(scored).select("doc_id", *[f"__q.{m}" for m in MEASURES], F.col("__kept").alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; nulls, ties and repeated rows as in :func:`judged`.

    Texts are measured twice, for the verdicts of their hosts and for their own; they are not written in between.
    """
    return judged(measured(docs)).filter("__kept").select(*docs.columns)
