import re
from collections import Counter

from lumentrace.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, c in Counter(windows).items() if c > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def key(x):
    return (x[0] is None, x[0] or 0, *x[1:])


def test_measures(spark, documents, odd, nothing):
    tricky = ["a b c d e f g h " * 2, "x " * 40, "a b c d e f g h i a b c d e f g h j b c d e f g h i", "l\nl\n\n \n l\nl", "###|<>\n" * 3, "é é é é é é é é é"]
    rows = spark.createDataFrame([(i, t, "s") for i, t in enumerate(tricky)], "doc_id long, text string, source string")
    for df in (documents, odd, rows):
        got = [(r["doc_id"], *[r[m] for m in Q.MEASURES]) for r in Q.verdicts(df).collect()]
        want = [(r["doc_id"], *brute(r["text"])) for r in df.select("doc_id", "text").collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert Q.verdicts(nothing).count() == 0 and Q.kept_documents(nothing).count() == 0


def test_host_verdicts(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [(h * 100 + i, bad if i < f else good, f"h{h}" if h else None) for h, f in enumerate([2, 40, 38, 3, 1]) for i in range(40)]
    rows += [(9000 + i, good, f"tiny{i}") for i in range(5)] + [(9100, bad, "tiny-bad")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hosts = {}
    for d, t, s in rows:
        n, f = hosts.get(s, (0, 0))
        hosts[s] = (n + 1, f + (t == bad))
    rates = [f / n for n, f in hosts.values()]
    mean = sum(rates) / len(rates)
    var = sum((r - mean) ** 2 for r in rates) / len(rates)
    strength = max(mean * (1 - mean) / var - 1, 1.0)
    out = {s for s, (n, f) in hosts.items() if (f + mean * strength) / (n + strength) > 0.5}
    assert {"h1", "h2"} <= out and None not in out
    for r in Q.verdicts(df).collect():
        t, s = next((t, s) for d, t, s in rows if d == r["doc_id"])
        assert r["kept"] == (t == good and s not in out)
    kept = Q.kept_documents(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, t, s in rows if t == good and s not in out)


def test_native(documents):
    plan = Q.measured(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
