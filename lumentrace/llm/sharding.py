"""Shards of near-equal bytes: longest processing time first, groups of equal texts stay together."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumentrace.llm.common import text_or_empty, written

SHARDS = 8
#: Small groups travel in this many parcels; a group larger than total / PARCELS is a parcel of its own.
PARCELS = 4096
#: Rows numbered by one task.
ROWS_PER_BUCKET = 20_000


def longest_first(sizes: Iterable[tuple[object, int]], shards: int) -> dict[object, int]:
    """Shard of each key: keys by falling size (ties by key), each to the least loaded shard, from a heap."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for key, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), unsigned CRC-32, and a group hash shared by equal texts."""
    t = text_or_empty(text)
    return docs.select(
        "doc_id",
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(text)).alias("__group"),
    )


def sharded(rows: DataFrame, shards: int = SHARDS, parcels: int = PARCELS) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows of :func:`sized`.

    Two texts with one 64-bit hash would merely share a shard. The schedule runs over at most
    ``2 * parcels`` loads whatever the input: a group above ``total / parcels`` is scheduled by itself (there
    can be no more than ``parcels`` of them), all others in ``parcels`` parcels by hash. Only those loads
    reach the driver. A group that holds more than a shard's share fills a shard alone. Null texts form a
    group, repeated rows stay together in slots of their own, an empty table gives an empty result.
    """
    rows = written(rows, "sizes")
    spark = rows.sparkSession
    groups = rows.groupBy("__group").agg(F.sum("size").alias("size"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).scalar()
    giant = F.col("size") * parcels > total
    parcel = F.pmod("__group", F.lit(parcels))
    loads = (
        groups.groupBy(giant.alias("alone"), F.when(giant, F.col("__group")).otherwise(parcel).alias("key"))
        .agg(F.sum("size").alias("size"))
        .collect()  # at most 2 * parcels rows
    )
    placed = longest_first([((r["alone"], r["key"]), r["size"]) for r in loads], shards)
    lookup = F.lit([placed.get((False, p), 0) for p in range(parcels)])
    giants = [(k, s) for (alone, k), s in placed.items() if alone]
    of_giants = spark.createDataFrame(giants, "__group long, __giant int")  # at most `parcels` rows
    shard = F.coalesce(F.col("__giant"), F.get(lookup, parcel.cast("int")))
    marked = rows.join(F.broadcast(of_giants), "__group", "left").withColumn("shard", shard.cast("int"))
    return slotted(marked.drop("__giant"))


def slotted(rows: DataFrame) -> DataFrame:
    """Gapless numbers from 0 in each shard, counted by many tasks."""
    buckets = rows.agg((F.ceil(F.count(F.lit(1)) / ROWS_PER_BUCKET) + 1)).scalar()
    marked = rows.withColumn("__b", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), buckets))
    counts = marked.groupBy("shard", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy("shard", "__b").orderBy("doc_id", "text_crc32", "size")
    return (
        marked.join(offsets, ["shard", "__b"])
        .withColumn("slot", F.col("__o") + F.row_number().over(inside) - 1)
        .drop("__b", "__o")
    )


def shards_of(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ``bytes``, shard, slot, grown_shard (null)."""
    return sharded(sized(docs), shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
