"""The join against all pairs compared as sets of word tuples."""

import random
import re

import numpy as np
import pytest

from lumentrace.llm import ngram_join as J
from lumentrace.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text, n):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, n, percent):
    sets = [brute_set(t, n) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    first = {}
    for i, s in enumerate(sets):
        if s:
            label[find(i)] = find(first.setdefault(s, i))
    keys = list(first.items())
    for a, (s, i) in enumerate(keys):
        for t, j in keys[a + 1 :]:
            if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
                same = len(s & t)
                if 100 * same >= percent * (len(s) + len(t) - same):
                    label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def key(x):
    return tuple((v is None, v or 0) for v in x)


def families(seed, count=60):
    """Families of near copies around both thresholds, passages that many texts share, and tiny texts."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(3000)}"
    passage, out = [word() for _ in range(60)], []
    for _ in range(count):
        base = [word() for _ in range(rnd.choice([1, 2, 4, 9, 12, 30, 80, 150, 400]))]
        if rnd.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rnd.randint(1, 6)):
            copy = list(base)
            for _ in range(rnd.randint(0, 1 + len(base) // 40)):
                i = rnd.randrange(len(copy))
                copy[i : i + rnd.randint(0, 2)] = [word() for _ in range(rnd.randint(0, 2))]
            out.append(" ".join(w.upper() if rnd.random() < 0.05 else w for w in copy))
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_families(spark, n, percent):
    rows = families(n)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, J.ngram_components(df, n, percent).collect()))
    assert got == sorted(brute(rows, n, percent))
    kept = sorted(r["doc_id"] for r in J.first_of_groups(df, n, percent).collect())
    assert kept == sorted(d for d, size, c in brute(rows, n, percent) if not size or c == d)


def test_split_components(spark, monkeypatch):
    """Components that are cut into many parts give the same classes."""
    monkeypatch.setattr(J, "PART_SHINGLES", 500)
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(120):
        copy = list(base)
        for _ in range(rnd.randint(0, 3)):
            copy[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
        rows.append((d, " ".join(copy[: rnd.choice([100, 108, 120])])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, J.ngram_components(df, 3, 90).collect())) == sorted(brute(rows, 3, 90))


def test_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert sorted(map(tuple, J.ngram_components(documents, 5, 80).collect())) == sorted(brute(rows, 5, 80))


def test_odd_rows(odd, nothing, spark):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(tuple, J.ngram_components(odd).collect()), key=key) == sorted(brute(rows, 3, 90), key=key)
    assert J.ngram_components(nothing).count() == 0 and J.first_of_groups(nothing, 5, 80).count() == 0
    kept = J.first_of_groups(odd, 3, 90)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and ids.count(2) == 0 and ids.count(10) == 2 and ids.count(3) == 1
    same = spark.createDataFrame([(5, "a b c d")] * 3 + [(4, None)] * 2, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in J.first_of_groups(same, 3, 90).collect()) == [4, 4, 5]


def test_keys_lose_no_pair():
    """Sets at exactly the threshold share a key whichever keys each leaves out."""
    rng = np.random.default_rng(0)
    for percent in (90, 80):
        for _ in range(200):
            size = int(rng.integers(2, 900))
            common = rng.integers(0, 2**64, size, np.uint64, endpoint=False)
            most = size * (100 - percent) // percent  # together the sets may have so many more
            extra = rng.integers(0, 2**64, most, np.uint64, endpoint=False)
            cut = int(rng.integers(0, most + 1))
            a, b = np.unique(np.concatenate([common, extra[:cut]])), np.unique(np.concatenate([common, extra[cut:]]))
            if np.array_equal(a, b):
                continue
            ka, sa = J.set_keys(a, percent)
            kb, sb = J.set_keys(b, percent)
            shared = set(ka.tolist()) & set(kb.tolist())
            spare = max([*(sa // 2).tolist(), *(sb // 2).tolist(), 0])
            assert len(shared) > 2 * spare - 1 and shared


def test_tree_prunes_only_what_cannot_link():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**64, int(rng.integers(3, 200)), np.uint64, endpoint=False)
        for _ in range(4):
            keep = rng.random(len(base)) > 0.03
            sets.append(np.unique(np.concatenate([base[keep], base[:1], rng.integers(0, 2**64, int(rng.integers(0, 4)), np.uint64, endpoint=False)])))
    want = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * J.overlap(sets[i], sets[j]) >= 90 * (len(sets[i]) + len(sets[j]) - J.overlap(sets[i], sets[j]))}

    def classes(pairs, n):
        label = list(range(n))
        for i, j in pairs:
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
        return {frozenset(k for k in range(n) if label[k] == x) for x in label}

    got = J.links(sets, None, 90)
    assert classes(got, len(sets)) == classes(want, len(sets)) and len(got) < len(want) + 1
    left, right = sets[::2], sets[1::2]
    place = {**{2 * i: i for i in range(len(left))}, **{2 * i + 1: len(left) + i for i in range(len(right))}}
    cross = {(place[i], place[j]) for i, j in want if i % 2 != j % 2}
    assert classes(J.links(left, right, 90), len(sets)) == classes(cross, len(sets))


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rnd.randrange(2000, 2400), rnd.randrange(2000, 2400)) for _ in range(150)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(500):
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
        if not moved:
            break
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["root"] for r in got} == {k: v for k, v in label.items() if k not in loops}
    assert len(got) == len({r["node"] for r in got})
