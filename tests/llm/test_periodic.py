import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrace.llm import periodic


def brute_runs(words):
    """Every maximal stretch of every period, the smallest period of a stretch only."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def fibonacci(n):
    a, b = "x", "xy"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def planted(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in rng.integers(0, 50 if seed % 2 else 3, 40)]
    for _ in range(3):
        q = int(rng.integers(1, 70))
        unit = [f"w{i}" for i in rng.integers(0, 1 + int(rng.integers(1, 30)), q)]
        words += (unit * 9)[: int(q * rng.uniform(2.5, 6))] + [f"v{i}" for i in rng.integers(0, 9, int(rng.integers(0, 5)))]
    return words


TEXTS = [planted(i) for i in range(40)] + [fibonacci(900), ["a"] * 24, ["a"] * 23, ["a"] * 700, list("ab") * 12, list("abc") * 8 + ["a"], [], ["one"],
                                          list("abcdefghi") * 3, list("abcdefghi") * 3 + ["a"], [f"u{i}" for i in range(200)] * 3]


@pytest.mark.parametrize("together", [True, False])
def test_runs_equal_brute_force(together):
    texts = [" ".join(w).encode() for w in TEXTS]
    if together:
        runs, short = periodic._searched(texts)
    else:
        parts = [periodic._searched([t]) for t in texts]
        runs, short = [r[0] for r, _ in parts], [s[0] for _, s in parts]
    for words, found, left in zip(TEXTS, runs, short, strict=True):
        want = brute_runs(words)
        assert [tuple(r) for r in found] == want
        assert left.decode() == brute_collapsed(words, want)


def test_strongest_is_exact():
    runs = [(0, 300, 100), (5, 301, 100), (9, 301, 100), (400, 30, 10)]
    assert periodic.strongest(runs) == (5, 301, 100)
    assert periodic.strongest([]) is None


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
            digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(brute_collapsed(words, runs)))


def test_digests_equal_brute_force_on_odd_rows(spark, odd, nothing):
    docs = odd.filter("doc_id IS NULL OR doc_id <> 8")
    want = sorted((brute_row(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert sorted((tuple(r) for r in periodic.run_digests(docs).collect()), key=repr) == want
    assert periodic.run_digests(nothing).count() == 0
    assert periodic.run_digests(odd).count() == odd.count()
    all_columns = periodic.with_runs(odd.withColumns({"start": F.lit(1), "length": F.lit(2), "period": F.lit(3)}))
    assert all_columns.columns[-2:] == ["__runs", "__collapsed"] and all_columns.count() == odd.count()


def test_query_equals_brute_force(documents):
    docs = documents.limit(60)
    rows = docs.select("doc_id", "text").collect()
    assert any(zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows)
    want = sorted((brute_row(r.doc_id, r.text) for r in rows), key=repr)
    assert sorted((tuple(r) for r in periodic.run_digests(docs).collect()), key=repr) == want


def test_very_long_text(spark):
    words = [f"w{i % 997}x{i // 2991}" for i in range(60_000)]
    row, = periodic.with_runs(spark.createDataFrame([(" ".join(words),)], "text string")).collect()
    assert [(r.start, r.length, r.period) for r in row["__runs"]] == [(k * 2991, 2991, 997) for k in range(20)]
    assert len(row["__collapsed"].split(" ")) == 60_000 - 20 * 2 * 997
