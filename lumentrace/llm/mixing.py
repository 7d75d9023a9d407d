"""Mixtures of sources at target weights: fixed blocks, multinomial draws per shard, permuted indices."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumentrace.llm.common import SPACES, join_facts, sliced, text_or_empty, words, written

#: Words in a block.
BLOCK = 64
#: A source gives at most so many times its size.
MAX_EPOCHS = 3
#: Slots of an output shard, and the most shards.
SHARD_SLOTS = 4096
MAX_SHARDS = 65_536
#: Documents laid out by one task.
DOCS_PER_BUCKET = 1_000
_BLANK = SPACES.encode()
_BLANKS = np.frombuffer(_BLANK, np.uint8)


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = MAX_EPOCHS) -> list[float]:
    """Shares of the total size by weight; a share above ``most`` times its size stops there, the excess goes
    to the others by weight until none is above."""
    out = [0.0] * len(sizes)
    left, open_ = float(sum(sizes)), [i for i, n in enumerate(sizes) if n > 0]
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * level > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * level
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each key, element by element.

    Four Feistel rounds on the next even number of bits; an image outside 0..n-1 is mapped again.
    """
    with np.errstate(over="ignore"):
        bits = np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64)
        half = (bits + np.uint64(1)) // np.uint64(2)
        mask = (np.uint64(1) << half) - np.uint64(1)
        out, todo = index.astype(np.uint64), np.arange(len(index))
        limit, key = n.astype(np.uint64), key.astype(np.uint64)
        while len(todo):
            x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
            left, right = x >> h, x & m
            for r in range(4):
                z = (right + k + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & m)
            out[todo] = x = (left << h) | right
            todo = todo[x >= limit[todo]]
    return out.astype(np.int64)


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size in words, and a hash that orders rows of one id."""
    return docs.select(
        "doc_id", "source", F.size(words(text_or_empty(text))).cast("long").alias("size"),
        F.xxhash64(F.col("doc_id"), F.col(text)).alias("__h"),
    )


def recipe(rows: DataFrame, block: int = BLOCK) -> list[dict]:
    """One entry per source by code point, null last; weights 1, 2, 3 repeating. One row per source reaches
    the driver: a recipe names its sources, so their number does not follow the documents."""
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    aims = targets([r["size"] for r in found], [1 + i % 3 for i in range(len(found))])
    out = []
    for i, (r, aim) in enumerate(zip(found, aims, strict=True)):
        blocks = -(-r["size"] // block)
        slots = min(round(aim * blocks / r["size"]), MAX_EPOCHS * blocks) if r["size"] else 0
        out.append({"sid": i, "source": r["source"], "source_size": r["size"], "target": aim, "blocks": blocks,
                    "slots": slots, "buckets": -(-r["docs"] // DOCS_PER_BUCKET)})
    return out


def recipe_table(spark: SparkSession, entries: list[dict]) -> DataFrame:
    return spark.createDataFrame(
        [(e["sid"], e["source"], e["source_size"], e["target"], e["blocks"], e["slots"], e["buckets"]) for e in entries],
        "sid int, source string, source_size long, target double, blocks long, slots long, buckets long",
    )


def drawn(spark: SparkSession, entries: list[dict], seed: int = 0) -> DataFrame:
    """shard, sid, start, n: the range of a source's slots that a shard takes.

    Each shard draws its counts from a multinomial with the recipe's shares, by its own seed. A source's
    ranges follow one another over the shards and end at its slots; what the draws leave short goes to one
    closing shard, so that every source meets its target.
    """
    slots = np.array([e["slots"] for e in entries], dtype=np.int64)
    total = int(slots.sum())
    schema = "shard long, sid int, n long"
    if total == 0:
        return spark.createDataFrame([], "shard long, sid int, start long, n long")
    per_shard = max(SHARD_SLOTS, -(-total // MAX_SHARDS))
    shards = -(-total // per_shard)
    shares = slots / total

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                size = min(per_shard, total - int(shard) * per_shard)
                n = np.random.default_rng([seed, int(shard)]).multinomial(size, shares)
                yield pd.DataFrame({"shard": shard, "sid": np.arange(len(n), dtype=np.int32), "n": n})

    counts = spark.range(0, shards, 1, min(shards, 64)).mapInPandas(draw, schema)
    so_far = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    aims = recipe_table(spark, entries).select("sid", "slots")
    ranges = counts.withColumn("end", F.sum("n").over(so_far)).join(F.broadcast(aims), "sid")
    clipped = ranges.select(
        "shard", "sid", F.least(F.col("end") - F.col("n"), "slots").alias("start"), F.least("end", "slots").alias("end")
    )
    closing = (
        clipped.groupBy("sid").agg(F.max("end").alias("start")).join(F.broadcast(aims), "sid")
        .select(F.lit(shards).cast("long").alias("shard"), "sid", "start", F.col("slots").alias("end"))
    )
    return clipped.unionByName(closing).select("shard", "sid", "start", (F.col("end") - F.col("start")).alias("n")).filter("n > 0")


def slots_of(spark: SparkSession, entries: list[dict], seed: int = 0) -> DataFrame:
    """shard, sid, slot, block: each slot of a source and the block its permutation puts there.

    Slot g lies in pass g // blocks; every pass has a permutation of its own, so no block is taken more often
    than there are passes begun.
    """
    table = recipe_table(spark, entries).select("sid", "blocks")
    slots = (
        drawn(spark, entries, seed)
        .repartition("sid", "shard")
        .select("shard", "sid", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("slot"))
        .join(F.broadcast(table), "sid")
    )

    # a map and not a function in a column: a join by the block would ask such a function twice, once to drop nulls, and
    # each task would hold two Python workers
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, g, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sid", "slot", "blocks"))
            with np.errstate(over="ignore"):
                key = (sid.astype(np.uint64) * np.uint64(1_000_003) + (g // n).astype(np.uint64)) * np.uint64(
                    0xD1342543DE82EF95
                ) + np.uint64(seed)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("shard", "sid", "slot")), pa.array(permuted(g % n, n, key), pa.int64())],
                names=["shard", "sid", "slot", "block"],
            )

    return slots.select("shard", "sid", "slot", "blocks").mapInArrow(index, "shard long, sid int, slot long, block long")


def laid_out(rows: DataFrame, table: DataFrame, sources: int) -> DataFrame:
    """Each row's recipe columns and ``start``: its first word's place in its source's stream.

    Rows of a source are dealt to buckets by hash and numbered there; bucket sums give the offsets, so a
    source with a third of all rows is laid out by many tasks.
    """
    keyed = table.withColumns({"__s": F.coalesce("source", F.lit("")), "__none": F.isnull("source")}).drop("source")
    with_source = rows.withColumns({"__s": F.coalesce("source", F.lit("")), "__none": F.isnull("source")})
    joined = join_facts(with_source, keyed, sources, ["__s", "__none"], "inner").drop("__s", "__none")
    marked = joined.withColumn("__b", F.pmod(F.xxhash64("doc_id", "__h"), F.col("buckets")))
    order = Window.partitionBy("sid", "__b").orderBy("doc_id", "__h", "size")
    inside = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy("sid", "__b").agg(F.sum("size").alias("__n"))
    before = Window.partitionBy("sid").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("sid", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    start = F.col("__o") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = marked.join(offsets, ["sid", "__b"]).withColumn("start", start)
    return placed.withColumn("__row", F.row_number().over(order)).drop("__o", "buckets")


def taken(docs: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and ``taken``, the words the mix takes from it.

    Null or empty text has size 0 and gives nothing; null is a source of its own, the last; repeated rows are
    rows of their own; an empty table gives an empty result. Equal inputs give equal results: draws and
    permutations depend on the seed and on counts only.
    """
    rows = written(sized(docs), "words")
    entries = recipe(rows, block)
    table = recipe_table(docs.sparkSession, entries)
    placed = laid_out(rows, table, len(entries))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last)))).withColumn(
        "__words",
        F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block),
    )
    times = slots_of(docs.sparkSession, entries, seed).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("__times"))
    return (
        pieces.join(times, ["sid", "block"], "left")
        .groupBy("sid", "__b", "__row", "doc_id", "size", "source_size", "target")
        .agg(F.sum(F.coalesce(F.col("__words") * F.col("__times"), F.lit(0))).cast("long").alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def cut(text: bytes, start: int, block: int) -> list[tuple[int, bytes]]:
    """(block, piece) pairs of a text whose first word is at ``start``; the pieces joined are the text."""
    if start % block == 0 and not text.strip(_BLANK):
        return []
    raw = np.frombuffer(text, np.uint8)
    word = ~np.isin(raw, _BLANKS)
    first = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    if not len(first):
        return []
    at = np.arange((-start) % block or block, len(first), block)
    ends = [0, *first[at].tolist(), len(text)]
    return [(start // block + i, text[a:b]) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]


def mixed(docs: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """The mix itself, with the columns of ``docs``: one row per slot and document with a part in its block.

    ``text`` is that part and ``n_chars`` its length; whole blocks come as often as the mix takes them. The
    parts of one pass over a document, in order, are its text. Empty documents have no part.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.withColumns({
        "size": F.size(words(text_or_empty())).cast("long"), "__h": F.xxhash64("doc_id", "text"), "__t": text_or_empty(),
        "__rest": F.struct(*keep),
    }).select("doc_id", "source", "size", "__h", "__t", "__rest")
    rows = written(rows.filter("size > 0"), "mix")
    entries = recipe(rows, block)
    placed = laid_out(rows, recipe_table(spark, entries), len(entries)).select("sid", "start", "__rest", "__t")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("__t").cast(pa.binary())
            found = [cut(t.as_py(), s, block) for t, s in zip(texts, batch.column("start").to_pylist(), strict=True)]
            of = np.repeat(np.arange(len(found)), [len(f) for f in found])
            taken_rows = batch.take(pa.array(of))
            yield pa.RecordBatch.from_arrays(
                [taken_rows.column("sid"), pa.array([b for f in found for b, _ in f], pa.int64()),
                 taken_rows.column("__rest"), pa.array([t for f in found for _, t in f], pa.binary()).cast(pa.string())],
                names=["sid", "block", "__rest", "text"],
            )

    schema = f"sid int, block long, __rest {placed.schema['__rest'].dataType.simpleString()}, text string"
    parts = placed.mapInArrow(pieces, schema)
    chosen = parts.join(slots_of(spark, entries, seed), ["sid", "block"])
    out = chosen.select("__rest.*", "text", F.char_length("text").cast("long").alias("n_chars"))
    return out.select(*docs.columns)
