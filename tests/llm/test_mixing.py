from collections import Counter, defaultdict

import numpy as np
import pytest

from lumentrace.llm import mixing as M

WORD = r"[^\x20\x09-\x0D]+"


def brute_targets(sizes, weights):
    """Share, stop at three times the size, share the excess again."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while left > 1e-9 and open_:
        total = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / total for i in open_}
        left = 0.0
        for i, s in share.items():
            out[i] += s
            if out[i] > 3 * sizes[i]:
                left += out[i] - 3 * sizes[i]
                out[i] = 3.0 * sizes[i]
        open_ = {i for i in open_ if out[i] < 3 * sizes[i]}
    return out


def test_targets():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        sizes = (rnd.pareto(1, 12) * 100).astype(int).tolist()
        weights = [1 + i % 3 for i in range(12)]
        assert M.targets(sizes, weights) == pytest.approx(brute_targets(sizes, weights))
    assert M.targets([], []) == [] and M.targets([0, 0], [1, 2]) == [0.0, 0.0] and M.targets([5], [1]) == [5.0]


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        for key in (0, 5):
            got = M.permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(got.tolist()) == list(range(n))
    assert M.permuted(np.arange(50), np.full(50, 50), np.full(50, 1)).tolist() != list(range(50))


def words_of(text):
    import re

    return re.findall(WORD, text or "")


def check(df, slack):
    rows = M.taken(df).collect()
    source = df.select("doc_id", "source", "text").collect()
    sizes = Counter()
    for r in source:
        sizes[r["source"]] += len(words_of(r["text"]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    aims = dict(zip(order, M.targets([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))])))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], r["size"]) for r in rows), key=key) == sorted(((r["doc_id"], len(words_of(r["text"]))) for r in source), key=key)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    by_aim = defaultdict(lambda: [0, 0])
    for r in rows:
        by_aim[(r["source_size"], round(r["target"], 6))][0] += r["taken"]
    for s in order:
        by_aim[(sizes[s], round(aims[s], 6))][1] += aims[s]
    assert all(abs(t - a) <= slack for t, a in by_aim.values()), dict(by_aim)
    return rows


def test_documents(documents):
    rows = check(documents, 3 * M.BLOCK)
    again = M.taken(documents.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_odd_rows(odd, nothing):
    check(odd, 3 * M.BLOCK)
    assert M.taken(nothing).count() == 0 and M.mixed(nothing).count() == 0


def test_draws_meet_slots(spark):
    entries = [{"sid": i, "source": str(i), "source_size": 1, "target": 1.0, "blocks": b, "slots": s, "buckets": 1}
               for i, (b, s) in enumerate([(5000, 9000), (4000, 4000), (10, 30), (3, 0), (2000, 123)])]
    rows = M.slots_of(spark, entries).collect()
    for e in entries:
        mine = sorted(r["slot"] for r in rows if r["sid"] == e["sid"])
        assert mine == list(range(e["slots"]))
        times = Counter(r["block"] for r in rows if r["sid"] == e["sid"])
        assert not times or (max(times.values()) <= -(-e["slots"] // e["blocks"]) and max(times) < e["blocks"])
    per_shard = Counter(r["shard"] for r in rows)
    assert max(per_shard.values()) <= M.SHARD_SLOTS and len(per_shard) >= 4


def python_steps(df):
    """The most Python steps that one task of a plan runs: each is a worker of its own."""
    above, most = [], 0
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        step = line.lstrip(" :+-*").lstrip("()0123456789 ")
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [x for x in above if x[0] < depth]
        if "Exchange" in step.split()[0]:
            above.append((depth, None))
        elif step.startswith(("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas")):
            above.append((depth, step))
            names = [x[1] for x in above]
            last = max((i for i, x in enumerate(names) if x is None), default=-1)
            most = max(most, len(names) - last - 1)
    return most


def test_a_task_holds_one_python_worker(documents):
    assert python_steps(M.mixed(documents)) == 1
    assert python_steps(M.taken(documents)) == 1


def test_mixed_is_what_taken_counts(documents):
    words = Counter()
    for r in M.mixed(documents).collect():
        words[r["doc_id"]] += len(words_of(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert {r["doc_id"]: r["taken"] for r in M.taken(documents).collect() if r["taken"]} == dict(words)


def test_cut():
    text = "  a b\tc\n\nd é f  "
    for start in range(7):
        pieces = M.cut(text.encode(), start, 3)
        assert b"".join(p for _, p in pieces).decode() == text
        at = start
        for block, piece in pieces:
            n = len(words_of(piece.decode()))
            assert at // 3 == block == (at + n - 1) // 3
            at += n
    assert M.cut(b" \n ", 3, 3) == [] and M.cut(b"", 1, 3) == []
