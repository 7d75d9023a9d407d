"""Exact Jaccard join of word shingles: lossless blocks, then signature trees with dual traversal.

Blocks. Two sets of sizes a and b with similarity t differ in at most (a + b)(1 - t) / (1 + t) shingles. Cut the
hash range into more parts than that: the sets agree on at least one part, and on 2s + 1 of them if there are
2s more. Equal parts give equal keys, and each set may leave out any s of its keys (the emptiest, and those
that most sets share) without losing a pair. Sets joined by keys make candidate components.

Trees. In a component, sets are sorted by size and smallest shingle and become the leaves of a tree. A node
holds the OR of the shingle bitmaps below it, the range of sizes, and the most shingles that share bits in a
set. Pairs of nodes are descended together; a pair goes when even the largest possible overlap is too small,
or when all its sets are already linked. Pairs of leaves that are left are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumentrace.llm.common import SPACES, sliced, text_or_empty, written
from lumentrace.llm.graph import components

#: Children of a tree node, and node pairs handled at once.
FAN = 8
PAIRS = 2048
#: Shingles that one side of a task may hold; larger components are cut into parts of this size.
PART_SHINGLES = 1_000_000
#: Candidates (three numbers each) up to which they are broadcast to pick their texts.
BROADCAST_CANDIDATES = 250_000
#: Stands for a null doc_id.
NO_ID = 2**63 - 1

_C = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES.encode())] = True
_BYTE = np.random.default_rng(9).integers(0, 2**64, 256, np.uint64, endpoint=False)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) <= n:
        size = max(2 * len(_POWERS[0]), n + 1)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            _POWERS[i] = np.cumprod(powers, dtype=np.uint64)
    return _POWERS


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of every word, A-Z lower-cased, from prefix sums of a polynomial over the bytes."""
    raw = np.frombuffer(text, np.uint8)
    word = np.zeros(len(raw) + 2, np.int8)
    word[1:-1] = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(word))
    up, down = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64, out=sums[1:])
    return _mix((sums[edges[1::2]] - sums[edges[::2]]) * down[edges[::2]])


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; fewer words make one, none make none."""
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mix(out * _C + words[i : len(words) - size + 1 + i])
    return np.unique(out)


def set_hash(sorted_hashes: np.ndarray) -> int:
    """One signed 64-bit number for a set of shingles."""
    return int(_mix(np.sum(_mix(sorted_hashes + _C), dtype=np.uint64, keepdims=True) + np.uint64(len(sorted_hashes))).view(np.int64)[0])


def size_edges(percent: int, largest: int) -> np.ndarray:
    """First sizes of the size classes; sizes that may link are in one class or in neighbours.

    The classes are as narrow as that allows: the fewer parts a set is cut into, the more shingles a part holds, and the
    less often do two sets agree on one by a passage they share.
    """
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * 100 // percent)))
    return np.array([*edges, max(edges[-1] + 1, -(-edges[-1] * 100 // percent))])


def parts_of(edges: np.ndarray, group: int, percent: int) -> tuple[int, int]:
    """(most differences of a pair whose larger set is in the class, keys each set may leave out)."""
    most = int(2 * (edges[group + 1] - 1) * (100 - percent) // (100 + percent))
    return most, -(-(most + 1) // 4)


def set_keys(hashes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set, and for each how many the set may still leave out in its class."""
    n = len(hashes)
    edges = size_edges(percent, n)
    own = int(np.searchsorted(edges, n, "right")) - 1
    keys, spare = [], []
    for group in (own, own + 1):
        if group > own and n * 100 // percent < edges[group]:
            continue  # no larger class holds a partner
        if group + 1 >= len(edges):
            edges = size_edges(percent, int(edges[-1]))
        most, leave = parts_of(edges, group, percent)
        if most == 0:
            continue  # only equal sets link, and those are one already
        parts = most + 1 + 2 * leave
        part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        bounds = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(hashes ^ _C), dtype=np.uint64)])
        held = _mix(sums[bounds[1:]] - sums[bounds[:-1]] + _mix(np.arange(parts, dtype=np.uint64) + np.uint64((group + 1) * int(_C) % 2**64)))
        first = -(-leave // 2)
        chosen = np.argsort(np.diff(bounds), kind="stable")[first:]
        keys.append(held[chosen])
        spare.append(np.full(len(chosen), (leave - first) * 2 + (group - own), np.int32))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(keys).view(np.int64), np.concatenate(spare)


class Tree:
    """Levels of nodes over sorted sets: OR-combined bitmaps, size ranges, most bit-sharing shingles."""

    def __init__(self, sets: list[np.ndarray], bits: int) -> None:
        self.order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i][0]))
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for row, i in enumerate(self.order):
            flags = np.zeros(bits, bool)
            flags[(sets[i] & np.uint64(bits - 1)).astype(np.int64)] = True
            maps[row] = np.packbits(flags).view(np.uint64)
        sizes = np.array([len(sets[i]) for i in self.order])
        slack = sizes - np.bitwise_count(maps).sum(1)
        self.levels = [(maps, sizes, sizes, slack)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, slack = self.levels[-1]
            at = np.arange(0, len(maps), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at),
                                np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))


def may_link(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Node pairs below which the largest possible overlap suffices."""
    (maps_a, low_a, high_a, slack_a), (maps_b, low_b, high_b, slack_b) = a, b
    low_a, low_b, high_a, high_b = low_a[i], low_b[j], high_a[i], high_b[j]
    common = np.bitwise_count(maps_a[i] & maps_b[j]).sum(1).astype(np.int64) + np.minimum(slack_a[i], slack_b[j])
    most = np.minimum(common, np.minimum(high_a, high_b))
    return (most * (100 + percent) >= percent * (low_a + low_b)) & (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))


def links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links inside ``left``, or between ``left`` and ``right``.

    Positions of ``right`` follow those of ``left``. Pairs that links already connect are not compared.
    """
    sets = left + (right or [])
    if len(sets) < 2:
        return []
    mean = sum(map(len, sets)) / len(sets)
    bits = 1 << int(np.ceil(np.log2(max(64, 4 * mean))))
    a = Tree(left, bits)
    b = a if right is None else Tree(right, bits)
    order_a, order_b = np.array(a.order), np.array(b.order) + (0 if right is None else len(left))
    label, members, found = np.arange(len(sets)), {}, []

    def join(x: int, y: int) -> None:
        x, y = int(label[x]), int(label[y])
        if len(members.get(x, (x,))) < len(members.get(y, (y,))):
            x, y = y, x
        moved = members.pop(y, [y])
        members.setdefault(x, [x]).extend(moved)
        label[moved] = x

    height = max(len(a.levels), len(b.levels)) - 1
    level = lambda tree, k: tree.levels[min(k, len(tree.levels) - 1)]
    stack = [(height, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        k, i, j = stack.pop()
        if len(i) > PAIRS:
            stack += [(k, i[s : s + PAIRS], j[s : s + PAIRS]) for s in range(0, len(i), PAIRS)][::-1]
            continue
        ends = []
        for order, tree in ((order_a, a), (order_b, b)):
            at = np.arange(0, len(order), FAN ** min(k, len(tree.levels) - 1))
            ends.append((np.minimum.reduceat(label[order], at), np.maximum.reduceat(label[order], at)))
        (low_a, high_a), (low_b, high_b) = ends
        one = (low_a[i] == high_a[i]) & (low_b[j] == high_b[j]) & (low_a[i] == low_b[j])
        keep = may_link(level(a, k), i, level(b, k), j, percent) & ~one
        i, j = i[keep], j[keep]
        if k == 0:
            for x, y in zip(order_a[i].tolist(), order_b[j].tolist(), strict=True):
                if label[x] != label[y]:
                    same = overlap(sets[x], sets[y])
                    if 100 * same >= percent * (len(sets[x]) + len(sets[y]) - same):
                        join(x, y)
                        found.append((x, y))
            continue
        step_a = FAN if k < len(a.levels) else 1
        step_b = FAN if k < len(b.levels) else 1
        child_i = (i[:, None] * step_a + np.repeat(np.arange(step_a), step_b)).ravel()
        child_j = (j[:, None] * step_b + np.tile(np.arange(step_b), step_a)).ravel()
        ok = (child_i < len(level(a, k - 1)[1])) & (child_j < len(level(b, k - 1)[1]))
        if b is a:
            ok &= child_i <= child_j if k > 1 else child_i < child_j
        child_i, child_j = child_i[ok], child_j[ok]
        near = np.argsort(np.abs(child_i - child_j), kind="stable")
        stack.append((k - 1, child_i[near], child_j[near]))
    return found


def signed_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, __th (hash of the text), n_shingles, and node (hash of the set, null if empty)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [shingles(text.as_py(), n) for text in batch.column(2).cast(pa.binary())]
            nodes = [set_hash(f) if len(f) else None for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(f) for f in found], pa.int64()), pa.array(nodes, pa.int64())],
                names=["doc_id", "__th", "n_shingles", "node"],
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("__th"), text_or_empty().alias("text"))
    return rows.mapInArrow(sign, "doc_id long, __th long, n_shingles long, node long")


def keyed_sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """node, keys and spare (as in :func:`set_keys`) of every text with shingles."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [f for text in batch.column(0).cast(pa.binary()) if len(f := shingles(text.as_py(), n))]
            keys = [set_keys(f, percent) for f in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_hash(f) for f in found], pa.int64()), pa.array([k for k, _ in keys], pa.list_(pa.int64())),
                 pa.array([s for _, s in keys], pa.list_(pa.int32()))],
                names=["node", "keys", "spare"],
            )

    return docs.select(text_or_empty().alias("text")).mapInArrow(sign, "node long, keys array<long>, spare array<int>")


def candidate_edges(sets: DataFrame) -> DataFrame:
    """Edges (u, v) from each set to the smallest set that shares a key with it.

    Keys are placed once, by key, to count the sets of each. A set then leaves out its most shared keys, as many
    as it may.
    """
    rows = sets.select("node", F.explode(F.arrays_zip("keys", "spare")).alias("k")).select(
        "node", F.col("k.keys").alias("key"), F.col("k.spare").alias("spare")
    )
    shared = rows.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("c > 1")
    hot_first = Window.partitionBy("node", "spare").orderBy(F.desc("c"), "key")
    left = shared.withColumn("r", F.row_number().over(hot_first)).filter(F.col("r") > F.shiftright("spare", 1))
    left = written(left.select("node", "key"), "keys")
    hubs = left.groupBy("key").agg(F.min("node").alias("v"))
    return left.join(hubs, "key").select(F.col("node").alias("u"), "v").filter("u <> v").distinct()


def tasks_of(candidates: DataFrame, percent: int) -> DataFrame:
    """(node, root, size) rows to (node, task, side): each task holds one part, or two, of a component.

    A component within PART_SHINGLES is one task. A larger one is cut by size class and hash; parts meet
    in pairs when their sizes allow a link.
    """
    step = 3 * (np.log(100) - np.log(percent))
    sized = candidates.withColumn("cls", F.floor(F.log("n_shingles") / F.lit(float(step))).cast("int"))
    totals = sized.groupBy("root").agg(F.sum("n_shingles").alias("total"))
    per_class = sized.groupBy("root", "cls").agg(F.ceil(F.sum("n_shingles") / PART_SHINGLES).alias("parts"))
    marked = (
        sized.join(totals, "root").join(per_class, ["root", "cls"])
        .withColumn("small", F.col("total") <= PART_SHINGLES)
        .withColumn("part", F.when(F.col("small"), F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), "parts")))
        .withColumn("cls", F.when(F.col("small"), F.lit(0)).otherwise(F.col("cls")))
    )
    # the partner parts of a part: those after it in its class, and all of the next class
    sums = marked.groupBy("root", "cls", "small").agg(F.max("parts").alias("n"))
    larger = sums.select("root", (F.col("cls") - 1).alias("cls"), F.col("n").alias("next"))
    pairs = (
        sums.join(larger, ["root", "cls"], "left")
        .withColumn("a", F.explode(F.when(F.col("small"), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0), F.col("n") - 1))))
        .withColumn("b", F.explode(F.concat(
            F.when(F.col("small"), F.array(F.struct(F.col("cls").alias("c"), F.lit(0).cast("long").alias("p")))).otherwise(
                F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda p: F.struct(F.col("cls").alias("c"), p.alias("p")))),
            F.when(F.col("small") | F.isnull("next"), F.array().cast("array<struct<c:int,p:bigint>>")).otherwise(
                F.transform(F.sequence(F.lit(0), F.col("next") - 1), lambda p: F.struct((F.col("cls") + 1).alias("c"), p.alias("p")))),
        )))
        .withColumn("task", F.xxhash64("root", "cls", "a", "b.c", "b.p"))
    )
    here = pairs.select("root", "cls", F.col("a").alias("part"), "task", F.lit(0).alias("side"))
    there = pairs.filter("b.c <> cls OR b.p <> a").select(
        "root", F.col("b.c").alias("cls"), F.col("b.p").alias("part"), "task", F.lit(1).alias("side")
    )
    return marked.join(here.unionByName(there), ["root", "cls", "part"]).select("node", "task", "side")


def found_links(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (u, v) inside each task, from rows (task, side, node, text) placed and sorted by task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sides = None, ({}, {})

        def flush() -> pa.RecordBatch:
            (left, right) = sides
            nodes = np.array([*left, *right], np.int64)
            pairs = links([*left.values()], [*right.values()] if right else None, percent) if left else []
            found = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(nodes[found[:, 0]]), pa.array(nodes[found[:, 1]])], names=["u", "v"])

        for batch in sliced(batches):
            columns = [batch.column(i).to_pylist() for i in range(3)]
            for t, side, node, text in zip(*columns, batch.column(3).cast(pa.binary()), strict=True):
                if t != task:
                    if task is not None:
                        yield flush()
                    task, sides = t, ({}, {})
                if node not in sides[side]:
                    found = shingles(text.as_py(), n)
                    if len(found) and set_hash(found) == node:
                        sides[side][node] = found
        if task is not None:
            yield flush()

    placed = rows.select("task", "side", "node", "text").repartition("task").sortWithinPartitions("task", "side")
    return placed.mapInArrow(search, "u long, v long")


def bounded(rows: DataFrame) -> DataFrame:
    """Rows of a few numbers, marked for broadcast if there are at most BROADCAST_CANDIDATES of them."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_CANDIDATES else rows


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose (__id, __th) is not among ``gone``."""
    return docs.join(bounded(gone), ["__id", "__th"], "left_anti")


def rows_with_roots(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, __th, n_shingles, node, root and component_id of every row; node and root are null without shingles."""
    sets = written(signed_sets(docs, n), "sets")
    with_id = sets.filter("node IS NOT NULL").withColumn("__id", F.coalesce("doc_id", F.lit(NO_ID)))
    nodes = with_id.groupBy("node").agg(F.min(F.struct("__id", "__th", "doc_id")).alias("k"), F.first("n_shingles").alias("n_shingles"))
    nodes = written(nodes.select("node", "n_shingles", "k.__id", "k.__th", F.col("k.doc_id").alias("first")), "nodes")
    # keys are made from one text of each set: all but the copies
    first = nodes.select("node", F.col("__id").alias("__i"), F.col("__th").alias("__t"))
    others = with_id.join(first, "node").filter("__id <> __i OR __th <> __t").select("__id", "__th").distinct()
    single = without(docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.xxhash64("text").alias("__th"), "text"), written(others, "copies"))
    around = components(candidate_edges(keyed_sets(single, n, percent)))
    picks = written(around.join(nodes.drop("first"), "node"), "candidates")
    tasks = tasks_of(picks.select("node", "root", "n_shingles"), percent)
    with_text = single.join(bounded(picks.select("node", "__id", "__th")), ["__id", "__th"])
    joined = with_text.select("node", "text").join(tasks, "node")
    roots = components(found_links(joined, n, percent))
    named = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_node = named.join(least, "root").select("node", "root", "component_id")
    rows = sets.select("doc_id", "__th", "n_shingles", "node").join(of_node, "node", "left")
    own = F.when(F.isnull("node"), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "__th", "n_shingles", "node", "root", own.alias("component_id"))


def ngram_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``, by its whole text.

    Two documents link when 100 * |intersection| >= percent * |union| of their distinct ``n``-word shingles
    (lower-cased A-Z; fewer words make one shingle). component_id is the smallest doc_id that links reach.
    Null or empty text, or text without words, has no shingle and links with nothing: its component is its
    own doc_id. Rows are judged one by one: repeated rows and rows of one doc_id with other texts link by
    their texts only; a null doc_id takes part and counts as the largest. An empty table gives an empty
    result; other columns are not read. Shingles and sets are told apart by 64-bit hashes.
    """
    return rows_with_roots(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def first_of_groups(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """One row of each component of ``docs``, with all its columns; rows without shingles all stay.

    The row is the one with the component's smallest doc_id (null is the largest), of several such rows that
    with the least hash of its text, and of equal rows any one.
    """
    keys = {"__id": F.coalesce("doc_id", F.lit(NO_ID)), "__th": F.xxhash64("text")}
    found = written(rows_with_roots(docs, n, percent).filter("node IS NOT NULL").withColumn("__id", keys["__id"]), "roots")
    best = found.groupBy("root").agg(F.min(F.struct("__id", "__th")).alias("k"))
    is_best = (F.col("__id") == F.col("k.__id")) & (F.col("__th") == F.col("k.__th"))
    marked = found.join(best, "root").withColumn("best", is_best).select("__id", "__th", "best")
    gone = written(marked.filter("NOT best").select("__id", "__th").distinct(), "gone")
    again = written(marked.filter("best").groupBy("__id", "__th").count().filter("count > 1").select("__id", "__th"), "again")
    kept = without(docs.withColumns(keys), gone)
    if not again.isEmpty():
        once = kept.join(bounded(again), ["__id", "__th"], "left_semi").dropDuplicates(["__id", "__th"])
        kept = without(kept, again).unionByName(once)
    return kept.select(*docs.columns)
