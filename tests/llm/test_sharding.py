import zlib
from collections import Counter, defaultdict

from lumentrace.llm import sharding as S


def check(df, shards=8):
    rows = S.shards_of(df, shards).collect()
    source = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in source), key=key)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=key) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    placed = defaultdict(set)
    by_text = defaultdict(set)
    for d, t in source:
        by_text[(len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), t is None)].add(d)
    for r in rows:
        placed[(r["size"], r["text_crc32"])].add(r["shard"])
    assert all(len(v) == 1 for k, v in placed.items() if k[0] > 1)
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    return loads


def test_documents(documents):
    loads = check(documents)
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) <= 0.01 * sum(loads.values())


def test_hot_group(spark):
    rows = [(i, "the same text again") for i in range(600)] + [(1000 + i, f"text {i} " * (i % 40)) for i in range(1500)]
    loads = check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    mean = sum(loads.values()) / 8
    assert all(abs(x - mean) < 0.02 * mean for x in loads.values())


def test_odd_rows(odd, nothing):
    check(odd)
    assert S.shards_of(nothing).count() == 0


def test_longest_first():
    sizes = {"a": 7, "b": 7, "c": 6, "d": 6, "e": 5, "f": 5, "g": 4, "h": 4, "i": 4}
    placed = S.longest_first(sizes.items(), 3)
    loads = Counter()
    for k, s in placed.items():
        loads[s] += sizes[k]
    assert sorted(loads.values()) == [15, 15, 18] or max(loads.values()) <= 4 / 3 * 16
