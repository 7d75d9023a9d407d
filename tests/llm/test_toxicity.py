import random

import numpy as np

from lumentrace.llm import toxicity as T


def corpus(n, seed):
    rnd = random.Random(seed)
    plain = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words = rnd.choices(plain, k=rnd.randint(10, 80))
        grade = rnd.choice([0, 0, 0, 1, 2])
        for _ in range({0: 0, 1: 2, 2: 12}[grade]):
            words.insert(rnd.randrange(len(words)), rnd.choice(["vile", "rotten", "nastyish", "Nastyer", "foul", "grim", "dross", "oaf", "cur", "knave", "dolt", "wretch"]))
        rows.append((i, " ".join(words), grade))
    return rows


def test_held_out():
    rows, rest = corpus(1200, 1), corpus(400, 2)
    model = T.graded([t for _, t, _ in rows], [int(g > 0) for *_, g in rows])
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    found = [(model.severity(t), g) for _, t, g in rest]
    assert sum((s >= T.REJECT_AT) == (g > 0) for s, g in found) >= 0.98 * len(found)
    mean = [sum(s for s, g in found if g == k) / sum(g == k for _, g in found) for k in range(3)]
    assert mean[0] < 0.3 < mean[1] < mean[2]
    assert sum(round(s) == g for s, g in found) >= 0.85 * len(found)


def test_probabilities_follow_one_score():
    """One weight vector: a text with more evidence is never less severe."""
    model = T.OrdinalModel({"a": 1.0, "b": 2.0}, (0.5, 2.0))
    scores = [model.severity(t) for t in ("", "a", "b", "a b")]
    assert scores == sorted(scores) and scores[0] > 0 and model.severity(None) == scores[0]
    assert abs(model.severity("a") - (1 / (1 + 2.718281828459045**-0.5) + 1 / (1 + 2.718281828459045**1.0))) < 1e-9


def test_query(spark, documents, sf, odd, nothing):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = T.severities(documents, labels).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in documents.collect())
    again = T.severities(documents.repartition(5), labels).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    model = T.sample_model(documents, labels)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert all(r["severity"] == model.severity(texts[r["doc_id"]]) for r in rows)
    no_labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert T.severities(odd, no_labels).count() == odd.count()
    assert T.severities(nothing, labels).count() == 0
    clean = T.clean_documents(odd, labels, documents)
    assert clean.columns == odd.columns
    with_copies = spark.createDataFrame([(1, "fine words"), (1, "fine words"), (2, None)], "doc_id long, text string")
    twice = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "doc_id long, toxic int")
    assert T.severities(with_copies, twice).count() == 3


def test_accuracy_on_documents(spark):
    """Fit on half of the labelled documents of sf0.01, judge the other half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = sorted((r["doc_id"], r["text"], r["toxic"]) for r in docs.join(labels, "doc_id").collect())
    fit, rest = rows[::2], rows[1::2]
    model = T.graded([t for _, t, _ in fit], [y for *_, y in fit])
    found = [(model.severity(t) >= T.REJECT_AT, y) for _, t, y in rest]
    assert sum(f for f, y in found if not y) <= 0.02 * len(found)
    assert sum(f for f, y in found if y) >= 0.5 * sum(y for _, y in found)


def penalised(parameters, x, y, weight, penalty):
    """Negative log likelihood of cumulative logits, written anew: P(y <= k) = 1 / (1 + exp(x w - theta_k))."""
    n = x.shape[1]
    w, theta = parameters[:n], parameters[n:]
    at_most = np.concatenate([np.zeros((len(x), 1)), 1 / (1 + np.exp((x @ w)[:, None] - theta)), np.ones((len(x), 1))], axis=1)
    likely = np.diff(at_most, axis=1)[np.arange(len(y)), y]
    return -(weight * np.log(likely)).sum() + penalty / 2 * (w**2).sum()


def test_fit_is_the_minimum_of_the_likelihood():
    """At the solution no small step in any direction that weights may take lowers the penalised likelihood."""
    rng = np.random.default_rng(4)
    words = ["vab", "veb", "vib", "vob", "vub", "vyb"]
    rates = np.array([[0.02] * 6, [0.5, 0.4, 0.3, 0.2, 0.15, 0.12], [0.8, 0.7, 0.6, 0.5, 0.4, 0.3]])
    grades = rng.integers(0, 3, 900)
    sets = [{w for w, p in zip(words, rates[g], strict=True) if rng.random() < p} | {"plain"} for g in grades]
    penalty = 3e-4
    model = T.fitted(sets, grades.tolist(), penalty=penalty, rounds=6000)
    assert set(model.weights) <= set(words) and len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    x = np.array([[w in s for w in words] for s in sets], float)
    share = np.bincount(grades, minlength=3)
    weight = 1 / (3 * share[grades])
    at = np.array([model.weights.get(w, 0.0) for w in words] + list(model.thresholds))
    least = penalised(at, x, grades, weight, penalty)
    for i in range(len(at)):
        for step in (-0.05, 0.05):
            other = at.copy()
            other[i] += step
            if i < len(words) and other[i] < 0:
                continue
            assert penalised(other, x, grades, weight, penalty) > least
    for text, s in ((" ".join(s), s) for s in sets[:50]):
        score = sum(model.weights.get(w, 0.0) for w in s)
        want = sum(1 / (1 + np.exp(t - score)) for t in model.thresholds)
        assert abs(model.severity(text) - want) < 1e-9


def test_model_reaches_workers_as_plain_values(spark, monkeypatch):
    """A broadcast is unpickled where the package may be missing: it holds a dict and a tuple only."""
    seen = []
    context = type(spark.sparkContext)
    whole = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: seen.append(value) or whole(self, value))
    model = T.OrdinalModel({"bad": 2.0}, (0.5, 1.5))
    df = spark.createDataFrame([(1, "bad word"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r["__severity"] for r in T.scored(df, model).collect()}
    assert rows == {1: model.severity("bad word"), 2: model.severity(None)}
    assert [type(v) for v in seen[0]] == [dict, tuple]
