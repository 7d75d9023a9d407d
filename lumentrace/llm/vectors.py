"""Near duplicates among embeddings, through a robust-pruned flat graph.

Equal vectors of a label are one node with a weight. The nodes of a label are spread over overlapping cluster shards:
each goes to its nearest centres. In every shard, nodes are tied to near ones by robust pruning, which keeps a
neighbour only if none kept before is much closer to it; the lists of a node from all its shards are united. Every
node is then searched for in each of its shards: best first from the medoid, then on through all nodes within
range. What is within range is verified in double precision. An audit compares a bounded sample of nodes with all
nodes; while it misses links, nodes also go to centres nearly as near, by a growing margin, and the graph is built again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrace.llm.common import join_facts, released, written
from lumentrace.llm.graph import components
from lumentrace.plans.skew import join_per_key

#: Cosine from which two vectors link.
RANGE = 0.93
#: Nodes that a shard should have, and those one side of a task may hold; larger shards are cut into parts.
SHARD, PART = 700, 1024
#: Centres of all labels together at most (they are broadcast), and nodes of a label that they are chosen from.
CENTRES, CENTRE_SAMPLE = 2048, 8
#: Centres a node goes to, the nearest ones; after an audit that failed also all whose cosine is less than a margin below the nearest one's.
OVERLAP, MARGIN = 3, 0.25
#: Neighbours of a node in a shard, candidates they are chosen from, and how much closer (in angle) one must be to prune.
DEGREE, POOL, SLACK = 16, 48, 1.2
#: Steps of the best-first search before it only goes on within range.
STEPS = 24
#: Nodes that an audit compares with all, and the share of their links that must have been found.
AUDIT, LEAST_RECALL = 256, 0.999

NODE = "node long, label string, vec array<double>, weight long, first long"


def usable(vector: Column) -> Column:
    """The vector as doubles, scaled by a power of two so that squares neither vanish nor overflow; null if it can't link.

    Null, empty or zero vectors, and those with null or non-finite components, can't.
    """
    doubles = vector.cast("array<double>")
    largest = F.array_max(F.transform(doubles, F.abs))
    sound = (F.size(doubles) > 0) & F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (largest > 0)
    return F.when(sound, F.transform(doubles, lambda x: x / F.pow(F.lit(2.0), F.floor(F.log2(largest)))))


def rows_of(embeddings: DataFrame) -> DataFrame:
    """vec_id and, for rows that may link, node: a hash of label, dimension and vector."""
    held = embeddings.select("vec_id", F.col("label").cast("string").alias("label"), usable(F.col("embedding")).alias("vec"))
    linked = F.col("label").isNotNull() & F.col("vec").isNotNull()
    return held.select("vec_id", "label", "vec", F.when(linked, F.xxhash64("label", "vec")).alias("node"))


def nodes_of(rows: DataFrame) -> DataFrame:
    """One row per node: its label (with the dimension, as only equal ones compare), vector, weight and smallest vec_id."""
    label = F.concat(F.size("vec"), F.lit(":"), F.col("label"))
    return rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.first(label).alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first")
    )


def centres_of(nodes: DataFrame) -> dict[str, np.ndarray]:
    """Centres of every label with more nodes than a shard holds, as unit vectors.

    A label gets about as many as it takes for shards of SHARD nodes; all labels share CENTRES. They are the nodes with the
    smallest hashes, moved once to the mean of the nodes around them in a sample of CENTRE_SAMPLE nodes for each.
    """
    sizes = nodes.groupBy("label").count().filter(F.col("count") > SHARD).orderBy(F.desc("count"), "label").limit(CENTRES // 2)
    held = {r.label: r["count"] for r in sizes.collect()}
    wanted = {label: -(-OVERLAP * n // SHARD) for label, n in held.items()}
    fit = min(1.0, CENTRES / max(1, sum(wanted.values())))
    wanted = {label: max(2, int(n * fit)) for label, n in wanted.items()}
    if not wanted:
        return {}
    spark = nodes.sparkSession
    asked = spark.createDataFrame([(label, n * CENTRE_SAMPLE, n * CENTRE_SAMPLE / held[label]) for label, n in wanted.items()], "label string, k long, share double")
    # of evenly spread hashes, those below twice the share hold the k smallest
    order = F.xxhash64("node")
    near = (order.cast("double") + 2.0**63) / 2.0**64 <= F.greatest(2 * F.col("share"), F.col("share") + 1e-6)
    sample = nodes.join(F.broadcast(asked), "label").filter(near).select("label", order.alias("h"), "vec")
    found = sample.toArrow()  # at most 2 * CENTRES * CENTRE_SAMPLE vectors, which stay flat arrays
    out = {}
    for label, n in wanted.items():
        mine = found.filter(pc.equal(found["label"], label))
        smallest = np.argsort(mine["h"].to_numpy(), kind="stable")[: n * CENTRE_SAMPLE]
        held_vectors = _matrix(mine["vec"].combine_chunks().take(pa.array(smallest)))
        first = held_vectors[:n]
        at = np.argmax(held_vectors @ first.T, 1)
        moved = np.array([held_vectors[at == i].sum(0) for i in range(len(first))])
        out[label] = moved / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-300)
    return out


def memberships(nodes: DataFrame, centres: dict[str, np.ndarray], margin: float) -> DataFrame:
    """Rows of ``nodes`` with ``shards``: the centres of their label that are nearest, or within ``margin`` (one shard where it has none)."""
    shared = nodes.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), object)
            lists = [[0]] * len(labels)
            for label in set(labels.tolist()) & shared.value.keys():
                of = np.flatnonzero(labels == label)
                near = _matrix(batch.column(2).take(pa.array(of))) @ shared.value[label].T
                ordered = -np.sort(-near, 1)
                floor = np.minimum(ordered[:, :OVERLAP][:, -1], ordered[:, 0] - margin)
                for i, row in zip(of.tolist(), near >= floor[:, None], strict=True):
                    lists[i] = np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], names=[*batch.schema.names, "shards"])

    return nodes.select("node", "label", "vec", "weight").mapInArrow(place, "node long, label string, vec array<double>, weight long, shards array<long>")


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Unit vectors as rows; all lists are equally long."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def tasks_of(members: DataFrame) -> DataFrame:
    """Rows of :func:`memberships`, once for each task they take part in: task, side and shard.

    A shard of at most PART nodes is one task. A larger one is cut into parts by hash, which meet in pairs (side -1 and 1) and
    alone (side 0).
    """
    spread = members.select("*", F.explode("shards").alias("shard"))
    sizes = spread.groupBy("label", "shard").count().select("label", "shard", F.ceil(F.col("count") / PART).alias("parts"))
    held = join_per_key(spread, sizes.filter("parts > 1"), ["label", "shard"], "left", spread=["node"], estimated=True)
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1), lambda p: F.struct(
        F.least(p, F.col("part")).alias("a"), F.greatest(p, F.col("part")).alias("b"), F.sign(F.col("part") - p).cast("int").alias("side")))
    met = held.withColumn("part", part).withColumn("t", F.explode(others))
    return met.select("node", "label", "vec", "weight", "shards", "shard", F.xxhash64("label", "shard", "t.a", "t.b").alias("task"), F.col("t.side").alias("side"))


def _per_task(rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` on the rows of each task (column ``task``, first), which are at most two parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            tasks = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(tasks)) + 1).tolist(), len(tasks)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    if held and held[-1].column(0)[0].as_py() != int(tasks[a]):
                        yield work(pa.Table.from_batches(held).combine_chunks())
                        held = []
                    held.append(batch.slice(a, b - a))
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition("task").sortWithinPartitions("task", "node").mapInArrow(run, schema)


def pruned(near: np.ndarray, degree: int = DEGREE, pool: int = POOL) -> np.ndarray:
    """Robust-pruned neighbours of every node (positions, -1 where there are fewer), from all cosines of a shard.

    Of a node's ``pool`` nearest, the nearest left is kept, and those that are SLACK times closer (in angle) to it than to
    the node go; until ``degree`` are kept.
    """
    n = len(near)
    pool = min(pool, n - 1)
    out = np.full((n, degree), -1, np.int64)
    if pool < 1:
        return out
    own = near.copy()
    np.fill_diagonal(own, -np.inf)
    pick = np.argpartition(-own, pool - 1, 1)[:, :pool]
    pick = np.take_along_axis(pick, np.argsort(-np.take_along_axis(own, pick, 1), 1, kind="stable"), 1)
    angle = np.arccos(np.clip(near, -1, 1)).astype(np.float32)
    mine, left, rows = np.take_along_axis(angle, pick, 1), np.ones(pick.shape, bool), np.arange(n)
    for k in range(degree):
        some = left.any(1)
        if not some.any():
            break
        at = np.argmax(left, 1)
        chosen = pick[rows, at]
        out[some, k] = chosen[some]
        left &= SLACK * angle[chosen[:, None], pick] > mine
        left[rows, at] = False
    return out


def reached(near: np.ndarray, lists: np.ndarray, least: float = RANGE, steps: int = STEPS) -> np.ndarray:
    """For every node, which nodes a search for it meets: best first from the medoid, then through all within range.

    As a query is a node of the graph, its own list is open from the start. A node that pruning dropped from it is behind
    one that is nearer, hence also within range. ``lists`` holds neighbours (positions, -1 for none). A query within range of what it met goes on from there
    until no node within range is left to go on from.
    """
    n = len(near)
    rows = np.arange(n)
    medoid = int(np.argmax(near.sum(0)))
    met, spent = np.zeros((n, n), bool), np.zeros((n, n), bool)
    met[:, medoid] = met[rows, rows] = True
    some = lists >= 0
    for _ in range(steps):
        open_ = np.where(met & ~spent, near, -np.inf)
        best = np.argmax(open_, 1)
        left = rows[open_[rows, best] > -np.inf]
        if not len(left):
            break
        spent[left, best[left]] = True
        at, of = lists[best[left]], some[best[left]]
        met[np.broadcast_to(left[:, None], at.shape)[of], at[of]] = True
    steps_of = np.zeros((n, n), np.float32)
    steps_of[np.broadcast_to(rows[:, None], lists.shape)[some], lists[some]] = 1
    np.maximum(steps_of, steps_of.T, out=steps_of)  # within range both directions are open: some nodes are in no other's list
    inside = near >= least
    while True:
        front = met & inside & ~spent
        if not front.any():
            return met
        spent |= front
        which = np.flatnonzero(front.any(1))
        met[which] |= (front[which].astype(np.float32) @ steps_of) > 0


def graph_of(tasks: DataFrame) -> DataFrame:
    """node and its united neighbours: the robust-pruned lists of all tasks it is in."""

    def build(rows: pa.Table) -> pa.RecordBatch:
        ids = rows["node"].to_numpy()
        lists = pruned(_gram(rows))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([ids[x[x >= 0]].tolist() for x in lists], pa.list_(pa.int64()))], names=["node", "near"])

    made = _per_task(tasks.select("task", "node", "vec"), build, "node long, near array<long>")
    return made.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def _gram(rows: pa.Table) -> np.ndarray:
    unit = _matrix(rows["vec"].combine_chunks())
    return np.clip(unit @ unit.T, -1, 1)


def found_links(tasks: DataFrame, graph: DataFrame, least: float = RANGE) -> DataFrame:
    """node, n (weights of the linked nodes met in this task) and root (the smallest node that links in this task reach).

    Two nodes may share several shards: a link counts in the first, and there in the task where their parts meet.
    """

    def search(rows: pa.Table) -> pa.RecordBatch:
        ids, side, weight = (rows[c].to_numpy() for c in ("node", "side", "weight"))
        near, shard = _gram(rows), rows["shard"][0].as_py()
        n = len(ids)
        flat = rows["near"].combine_chunks()
        sizes = np.diff(flat.offsets.to_numpy())
        targets = flat.flatten().to_numpy()
        at = np.minimum(np.searchsorted(ids, targets), n - 1)  # rows come by node
        here = ids[at] == targets
        owner = np.repeat(np.arange(n), sizes)[here]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        lists = np.full((n, int(rank.max(initial=0)) + 1), -1, np.int64)
        lists[owner, rank] = at[here]
        linked = reached(near, lists, least) & (near >= least)
        linked |= linked.T
        np.fill_diagonal(linked, False)
        counted = linked & ~_share([[s for s in x if s < shard] for x in rows["shards"].to_pylist()])
        if side.any():
            counted &= side[:, None] != side[None, :]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array((counted @ weight).astype(np.int64)), pa.array(ids[_least_reached(linked)])], names=["node", "n", "root"])

    rows = join_per_key(tasks, graph, ["node"], salts=1)
    return _per_task(rows.select("task", "node", "side", "weight", "shard", "shards", "vec", "near"), search, "node long, n long, root long")


def _share(lists: list[list[int]]) -> np.ndarray:
    """Which pairs of nodes have a common entry in their lists."""
    entries = {s: k for k, s in enumerate(sorted({s for x in lists for s in x}))}
    marks = np.zeros((len(lists), len(entries)), np.float32)
    for i, x in enumerate(lists):
        marks[i, [entries[s] for s in x]] = 1
    return marks @ marks.T > 0


def _least_reached(linked: np.ndarray) -> np.ndarray:
    """The smallest position that links reach from each."""
    roots = np.arange(len(linked))
    while True:
        around = np.minimum(roots, np.where(linked, roots, len(roots)).min(1, initial=len(roots)))
        around = around[around]
        if np.array_equal(around, roots):
            return roots
        roots = around


def audited(nodes: DataFrame, links: DataFrame, least: float = RANGE, sample: int = AUDIT) -> float:
    """The share of the links of ``sample`` nodes (those with the smallest hashes) that ``links`` (node, n) counts.

    The sample is bounded and compared with every node of its label, in double precision.
    """
    held = nodes.orderBy(F.xxhash64("node", F.lit(13)), "node").limit(sample).select("node", "label", "vec").collect()
    by_label: dict[str, tuple[list[int], np.ndarray]] = {}
    for label in {r.label for r in held}:
        mine = [r for r in held if r.label == label]
        unit = np.array([r.vec for r in mine])
        by_label[label] = ([r.node for r in mine], unit / np.linalg.norm(unit, axis=1, keepdims=True))
    shared = nodes.sparkSession.sparkContext.broadcast(by_label)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, weight = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object), batch.column(3).to_numpy()
            for label in set(labels.tolist()) & shared.value.keys():
                of = np.flatnonzero(labels == label)
                asked, unit = shared.value[label]
                near = unit @ _matrix(batch.column(2).take(pa.array(of))).T >= least
                near &= np.array(asked)[:, None] != ids[of][None, :]
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array((near @ weight[of]).astype(np.int64))], names=["node", "n"])

    true = nodes.select("node", "label", "vec", "weight").mapInArrow(compare, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    pairs = links.groupBy("node").agg(F.sum("n").alias("found"))
    both = true.join(pairs, "node", "left").agg(F.sum("n"), F.sum(F.least("n", F.coalesce("found", F.lit(0))))).first()
    return 1.0 if not both[0] else both[1] / both[0]


def linked_nodes(nodes: DataFrame, least: float = RANGE) -> DataFrame:
    """node, n and root rows as in :func:`found_links`, of a graph whose audit passed (a written table).

    There is no margin at first; it grows until the audit passes or every node is in every shard of its label.
    """
    centres, margin = centres_of(nodes), 0.0
    while True:
        members = written(memberships(nodes, centres, margin), "members")
        tasks = tasks_of(members)
        graph = written(graph_of(tasks), "graph")
        links = written(found_links(tasks, graph, least), "links")
        released(graph)
        released(members)
        if not centres or margin >= 2 or audited(nodes, links, least) >= LEAST_RECALL:
            return links
        released(links)
        margin = max(MARGIN, 2 * margin)


def vector_components(embeddings: DataFrame, least: float = RANGE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``embeddings`` (vec_id, embedding, label).

    Rows link when their labels are equal and not null, their vectors equally long and the cosine at least ``least``.
    n_links counts other rows linked directly, equal ones included; component_id is the smallest vec_id that
    links reach (null counts as the largest); kept says that it is the row's own. Vectors that are null, empty or zero, or
    hold null or non-finite components, link with nothing and are kept under their own vec_id, as are null labels.
    Repeated rows link with each other and share vec_id and verdict. An empty table gives an empty result; other columns
    are not read. Vectors are told apart by 64-bit hashes.
    """
    rows = written(rows_of(embeddings), "rows")
    nodes = written(nodes_of(rows), "nodes")
    links = linked_nodes(nodes, least)
    roots = components(links.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    # tables with a row for each node are merged: their packed size says little of what a broadcast takes
    counted = nodes.select("node", "weight", "first").join(counts.hint("merge"), "node", "left")
    named = counted.join(roots.hint("merge"), "node", "left")
    smallest = named.filter("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("component_id"))
    placed = join_per_key(named.withColumn("root", F.coalesce("root", "node")), smallest, ["root"], "left", spread=["node"])  # a root may have most nodes
    n_links = F.col("weight") - 1 + F.coalesce("n", F.lit(0))
    facts = written(placed.select("node", n_links.alias("n_links"), F.coalesce("component_id", "first").alias("component_id")), "facts")
    out = join_facts(rows.select("vec_id", "node"), facts, facts.count(), ["node"], estimated=False)
    component = F.when(F.isnull("node"), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
