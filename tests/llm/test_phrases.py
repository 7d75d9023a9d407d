import re
from collections import Counter

import numpy as np
import pytest

from lumentrace.llm import phrases
from lumentrace.llm.common import written


def brute(rows, least, longest, top):
    counts, sums = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            sums[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        n, rows = sums[lang], []
        for p, a in found.items():
            if any(b >= a and len(o) > len(p) and any(o[i : i + len(p)] == p for i in range(len(o))) for o, b in found.items()):
                continue
            score, _, le, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), le, r))
        for rank, (s, a, p, le, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, le, r, n, -s))
    return sorted(out)


def some_rows(seed=1, n=400):
    rng = np.random.default_rng(seed)
    common = ["New York City", "machine learning", "of the", "a priori", "à la carte", "x. y", "in so far as"]
    rows = []
    for i in range(n):
        words = [f"w{x}" for x in rng.zipf(1.5, 30) % 300]
        for c in rng.choice(common, 6):
            words.insert(int(rng.integers(0, len(words))), c)
        text = " ".join(words) + ("\t tail; " if i % 3 else "\nEnd")
        rows.append((text, [None, "en", "fr", "und"][i % 4]))
    return rows + [(None, "en"), ("", None), (" \t\n", "xx"), ("...", "yy")]


@pytest.mark.parametrize("least,longest,top", [(20, 5, 2000), (7, 4, 15), (60, 2, 2000)])
def test_equals_brute_force(spark, least, longest, top):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    found = phrases.collocations(docs, least, longest, top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, least, longest, top)
    assert want and sorted(tuple(r) for r in found.collect()) == want


def test_nothing_and_extra_columns(spark, odd, nothing):
    assert phrases.collocations(nothing).collect() == []
    rows = [(r.text, r.lang) for r in odd.collect()]
    assert sorted(tuple(r) for r in phrases.collocations(odd, 3).collect()) == brute(rows, 3, 5, 2000)


@pytest.mark.parametrize("parts", [1, 5])
def test_summaries_keep_what_is_frequent(parts):
    rng = np.random.default_rng(parts)
    mass, least = 20_000, 100
    stream = np.concatenate([np.repeat(np.arange(1, 60), 100), rng.integers(1000, 2**40, mass - 5900)]).astype(np.uint64)
    stream = rng.permutation(stream)
    whole = phrases.Summary(mass // least + 1)
    for part in np.array_split(stream, parts):
        one = phrases.Summary(mass // least + 1)
        for block in np.array_split(part, 11):
            one.add(*np.unique(block, return_counts=True))
        whole.add(one.hashes, one.counts, one.taken)
    assert whole.taken < least and len(whole.hashes) <= mass // least + 1
    assert set(range(1, 60)) <= set(whole.frequent(least).tolist())


def test_summaries_drop_most_of_the_rest(spark):
    rng = np.random.default_rng(3)
    rows = [(" ".join(f"u{x}" for x in rng.integers(0, 10**7, 200)) + " , tick tock", "en") for _ in range(300)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    found = phrases.summarised(docs, [2], 100, 10**5, words=b"\xff" * (phrases.BITS // 8))
    assert 1 <= found.count() <= 10


def test_bitmap(spark):
    hashes = [0, 1, 5, phrases.BITS - 1, -1, 2**40 + 7, 32767, 32768]
    bitmap = phrases.bitmap_of(written(spark.createDataFrame([(h,) for h in hashes], "h long"), "bits"))
    asked = np.array(hashes + [2, 8, 32766, 32769, 2**50 + 3], np.int64).view(np.uint64)
    assert phrases.among(bitmap, asked).tolist() == [True] * len(hashes) + [False] * 5
    assert len(bitmap) == phrases.BITS // 8


def test_long_texts_are_cut_between_pieces(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 64)
    import pyarrow as pa

    text = " ".join(f"alpha beta gamma {i}, delta" for i in range(50))
    batch = pa.RecordBatch.from_arrays([pa.array([text, "x y", text]), pa.array(["en", "fr", "en"])], names=["text", "lang"])
    found = Counter()
    for block in phrases.blocks(iter([batch])):
        for n, hashes, whole in block.phrases([1, 2, 3]):
            for i in np.flatnonzero(whole):
                found[(block.langs[block.row[i]], block.phrase(int(i), n))] += 1
    assert found["en", "alpha beta gamma"] == 100 and found["fr", "x y"] == 1 and found["en", "delta"] == 100
    assert found["en", "delta alpha"] == 98 and ("en", "delta x") not in found
