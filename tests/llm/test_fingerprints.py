"""Fingerprints against a plain Python version of the same method."""

import hashlib
import struct

import xxhash

from lumentrace.llm import fingerprints as P

SPACES = " \t\n\x0b\x0c\r"


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def of_string(s):
    return xxhash.xxh64(s.encode(), seed=42).intdigest()


def of_longs(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64(struct.pack("<Q", v), seed=seed).intdigest()
    return seed


def words(text):
    lower = text.lower()
    for c in SPACES:
        lower = lower.replace(c, " ")
    return [w for w in lower.split(" ") if w]


def walk(i, s):
    return ((((i * 30011 + 7919) >> 2)) + (((i * 40503 + 12345) >> 3) | 1) * s) % 256


def fingerprint(text):
    hashes = [of_string(w) for w in words(text)]
    if not hashes:
        return None
    size = min(5, len(hashes))
    bins = {}
    for i in range(len(hashes) - size + 1):
        h = of_longs(hashes[i : i + size])
        b = ((h >> 56) + 128) % 256
        bins[b] = min(bins.get(b, 2**64), h & (2**56 - 1))
    low = [bins[b] & 15 if b in bins else None for b in range(256)]
    return [next(low[c] for c in ([b] if low[b] is not None else []) + [walk(b, s) for s in range(256)] if low[c] is not None) for b in range(256)]


def near(a, b):
    if a is None or b is None:
        return float(a is b)
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / 256 - 1 / 16) / (15 / 16))


def expected(rows):
    """rows: (doc_id, text); ids are distinct and not null."""
    rows = sorted(((d, t or "") for d, t in rows), reverse=True)
    out = {}
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        a, b, c = fingerprint(t), fingerprint(edited), fingerprint(following)
        show = lambda f: "" if f is None else "".join(f"{x:x}" for x in f)
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(b), near(a, b), near(a, c))
    return out


def compare(df, rows):
    want = expected(rows)
    got = {r[0]: tuple(r)[1:] for r in P.document_fingerprints(df).collect()}
    assert got.keys() == want.keys()
    for d, w in want.items():
        assert got[d][:4] == w[:4], d
        assert abs(got[d][4] - w[4]) < 1e-9 and abs(got[d][5] - w[5]) < 1e-9, d


def test_all_documents(documents):
    compare(documents, [(r["doc_id"], r["text"]) for r in documents.collect()])


def test_uneven_ids(spark):
    rows = [(i * i * i - 50, f"text {i} " * (i % 7)) for i in range(60)] + [(10**17, "far away " * 9), (-(10**15), None)]
    compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_odd_rows(odd, nothing, spark):
    rows = P.document_fingerprints(odd).collect()
    assert len(rows) == odd.count()
    same = {r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)}
    assert len(same) == 1
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (3, 4, 5)} == {""}
    assert P.document_fingerprints(nothing).count() == 0
    (one,) = P.document_fingerprints(spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert one["near_next"] == 1.0


def test_walk_visits_every_bin():
    assert all(len({walk(i, s) for s in range(256)}) == 256 for i in range(256))


def test_estimate(spark):
    """Texts that share a known part of their shingles."""
    words_ = [f"w{i}" for i in range(4000)]
    rows = [(2 * k, " ".join(words_[:2000])) if i == 0 else (2 * k - 1, " ".join(words_[k * 100 : 2000 + k * 100])) for k in range(1, 12) for i in (0, 1)]
    got = {r["doc_id"]: r["near_next"] for r in P.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(1, 12):
        common = 2000 - 100 * k - 4
        assert abs(got[2 * k] - common / (2 * 1996 - common)) < 0.13
