import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrace.llm import common, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node string, n long, task int"


def brute(rows, least):
    sound = [label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if s else None for s, (_, v, _) in zip(sound, rows, strict=True)]
    n = len(rows)
    linked = [[j for j in range(n) if i != j and sound[i] and sound[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j])
               and float(unit[i] @ unit[j]) >= least] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least_id = min(ids, default=None)
        out.append((rows[i][0], len(linked[i]), least_id, rows[i][0] == least_id))
    return sorted(out, key=repr)


def found(spark, rows, least=vectors.RANGE, parts=3):
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in vectors.vector_components(df, least).collect()), key=repr)


def near_copies(rng, n, dim, groups, spread):
    centres = rng.normal(size=(groups, dim))
    of = rng.integers(0, groups, n)
    return (centres[of] + spread * rng.normal(size=(n, dim))).astype(np.float32).astype(float)


def test_odd_rows(spark):
    one = [0.5, 0.25, -1.0, 0.0]
    rows = [
        (1, one, 7), (2, one, 7), (2, one, 7), (3, [2 * x for x in one], 7), (4, one, 8), (5, one, None), (6, None, 7), (7, [], 7),
        (8, [0.0] * 4, 7), (9, [0.5, None, -1.0, 0.0], 7), (10, [float("nan")] * 4, 7), (11, [float("inf"), 0.0, 0.0, 0.0], 7), (None, one, 7),
        (12, [1e-30 * x for x in one], 7), (13, [1e30 * x for x in one], 7), (14, one[:3], 7), (15, [0.5, 0.25, -1.0, 0.05], 7), (16, [-x for x in one], 7),
        (None, [0.0, 0.0, 0.0, 1.0], 9), (10, [0.5, 0.25, -0.9, 0.0], 7),
    ]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows]
    assert found(spark, rows) == brute(rows, vectors.RANGE)
    assert found(spark, []) == []


@pytest.mark.parametrize("shard,part", [(700, 1024), (40, 1024), (40, 16)])
def test_equals_brute_force(spark, monkeypatch, shard, part):
    monkeypatch.setattr(vectors, "SHARD", shard)
    monkeypatch.setattr(vectors, "PART", part)
    rng = np.random.default_rng(5)
    v = near_copies(rng, 360, 16, 60, 0.25)
    v[300:330] = v[3]  # a group of equal vectors
    rows = [(int(i) * 3 % 997, v[i].tolist(), 0 if i % 3 else int(i) % 4) for i in range(len(v))]
    want = brute(rows, 0.9)
    assert sum(r[1] for r in want) > 500
    assert found(spark, rows, 0.9) == want


def test_dense_group_in_a_hot_label(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 30)
    monkeypatch.setattr(vectors, "PART", 32)
    rng = np.random.default_rng(6)
    v = np.concatenate([near_copies(rng, 120, 24, 1, 0.05), near_copies(rng, 120, 24, 120, 0.0)])
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    want = brute(rows, vectors.RANGE)
    assert max(r[1] for r in want) == 119 and found(spark, rows) == want


def test_pruning_drops_neighbours_behind_nearer_ones():
    angles = np.array([0.0, 0.1, 0.11, 0.12, -0.2])
    unit = np.stack([np.cos(angles), np.sin(angles)], 1)
    lists = vectors.pruned(np.clip(unit @ unit.T, -1, 1), degree=3, pool=4)
    assert lists[0].tolist() == [1, 4, -1]  # 2 and 3 are closer to 1 than to 0


def test_search_goes_on_within_range():
    angles = np.linspace(0, 1.5, 60)
    unit = np.stack([np.cos(angles), np.sin(angles)], 1)
    near = np.clip(unit @ unit.T, -1, 1)
    lists = vectors.pruned(near, degree=2, pool=6)
    met = vectors.reached(near, lists, 0.93, steps=40)
    assert met[near >= 0.93].all()


def test_audit_sees_missing_links(spark):
    rng = np.random.default_rng(8)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(near_copies(rng, 80, 8, 4, 0.05))]
    df = spark.createDataFrame([(*r, "", 1, 2) for r in rows], SCHEMA)
    nodes = vectors.nodes_of(vectors.rows_of(df)).persist()
    links = vectors.linked_nodes(nodes)
    assert vectors.audited(nodes, links) == 1.0
    less = links.withColumn("n", (links.n / 2).cast("long"))
    assert 0.4 < vectors.audited(nodes, less) < 0.6
    nodes.unpersist()


def test_tables_of_many_nodes_are_merged(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    plans = {}

    def planned(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return df

    monkeypatch.setattr(vectors, "written", lambda df, name: common.written(planned(df, name), name))
    v = near_copies(np.random.default_rng(9), 90, 8, 20, 0.1)
    v[40:60] = v[3]
    rows = [(i, x.tolist(), i % 2) for i, x in enumerate(v)]
    df = spark.createDataFrame([(*r, "", 1, 2) for r in rows], SCHEMA)
    out = planned(vectors.vector_components(df), "out")
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(rows, vectors.RANGE)
    assert "SortMergeJoin" in plans["facts"] and "SortMergeJoin" in plans["out"]
    assert "Broadcast" not in plans["facts"] + plans["out"]


def test_centres_are_means_around_the_nodes_with_the_smallest_hashes(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 30)
    v = near_copies(np.random.default_rng(10), 300, 8, 12, 0.2)
    df = spark.createDataFrame([(i, x.tolist(), i % 2, "", 1, 2) for i, x in enumerate(v)], SCHEMA).repartition(3)
    nodes = vectors.nodes_of(vectors.rows_of(df))
    held = nodes.withColumn("h", F.xxhash64("node")).orderBy("h").collect()
    found = vectors.centres_of(nodes)
    assert sorted(found) == ["8:0", "8:1"]
    for label, centres in found.items():
        unit = np.array([r.vec for r in held if r.label == label])
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        n = len(centres)
        assert n == -(-vectors.OVERLAP * len(unit) // 30)
        unit = unit[: n * vectors.CENTRE_SAMPLE]
        at = np.argmax(unit @ unit[:n].T, 1)
        want = np.array([unit[at == i].sum(0) for i in range(n)])
        assert np.allclose(centres, want / np.linalg.norm(want, axis=1, keepdims=True))
