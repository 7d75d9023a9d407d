"""Severity of toxic language: cumulative-link ordinal regression on sparse word features.

P(grade <= k | x) = 1 / (1 + exp(w.x - theta_k)): one weight vector for all ordered thresholds. The expected
severity is the sum over k of P(grade > k).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrace.llm.common import sliced

#: Labelled documents of each label that the model is fitted on, chosen by a hash of their ids.
FIT_ROWS = 2_000
#: Features that the model may have.
FEATURES = 1 << 14
#: How much more common a cue is in toxic documents, and its least log-likelihood ratio.
LIFT = 5
MIN_G2 = 25.0
#: A document is rejected when its expected severity is at least this.
REJECT_AT = 0.5
ROUNDS = 300
_TOKEN = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """Distinct words (runs of letters, in lower case) and the first four and five letters of longer ones.

    A prefix ends in a dash; it finds a stem whatever ending follows.
    """
    words = set(_TOKEN.findall(text.lower()))
    return words | {w[:4] + "-" for w in words if len(w) > 4} | {w[:5] + "-" for w in words if len(w) > 5}


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by word, and rising thresholds; ``len(thresholds) + 1`` grades."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def severity(self, text: str | None) -> float:
        return severity(text, self.weights, self.thresholds)


def severity(text: str | None, weights: dict[str, float], thresholds: Sequence[float]) -> float:
    """Expected grade of a text (null: empty): each known feature counts once."""
    score = sum(map(weights.__getitem__, features(text or "") & weights.keys()))
    return float(sum(1 / (1 + np.exp(np.clip(t - score, -50, 50))) for t in thresholds))


def cues(sets: list[set[str]], grades: list[int]) -> list[str]:
    """Features that are LIFT times as common in documents above grade 0 and whose log-likelihood ratio is
    at least MIN_G2; at most FEATURES of them, the strongest first."""
    counts = (Counter(), Counter())
    for found, grade in zip(sets, grades, strict=True):
        counts[grade > 0].update(found)
    n1 = sum(g > 0 for g in grades)
    n0 = len(grades) - n1
    scores = {}
    for f, a in counts[1].items():
        c = counts[0][f]
        if a * max(n0, 1) >= LIFT * c * max(n1, 1):
            both, rest = a + c, n0 + n1 - a - c
            cells = ((a, both * n1), (c, both * n0), (n1 - a, rest * n1), (n0 - c, rest * n0))
            scores[f] = 2 * sum(x * np.log(x * (n0 + n1) / e) for x, e in cells if x)
    strong = sorted((f for f, g in scores.items() if g >= MIN_G2), key=lambda f: (-scores[f], f))
    return strong[:FEATURES]


def fitted(sets: list[set[str]], grades: list[int], penalty: float = 3e-4, rounds: int = ROUNDS) -> OrdinalModel:
    """Maximum likelihood with a ridge penalty on the cues' weights (none is negative), by Adam on all rows.

    Equal inputs give equal models. Grades that no document has only move thresholds; a sample of one grade
    has no cues.
    """
    vocabulary = cues(sets, grades)
    index = {w: i for i, w in enumerate(vocabulary)}
    columns = [sorted(index[w] for w in s & index.keys()) for s in sets]
    rows = np.repeat(np.arange(len(sets)), [len(c) for c in columns])
    flat = np.array([i for c in columns for i in c], np.int64)
    y, top = np.array(grades, np.int64), max([*grades, 1])
    # each class weighs the same, so that rare grades count
    share = np.bincount(y, minlength=top + 1).astype(float)
    weight = 1 / (np.count_nonzero(share) * np.maximum(share[y], 1)) if len(y) else np.zeros(0)
    start = np.linspace(-1, 1, top) if top > 1 else np.zeros(1)
    parameters = np.concatenate([np.zeros(len(vocabulary)), start[:1], np.log(np.diff(start))])
    m, v = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, rounds + 1 if len(y) else 1):
        w, first, gaps = parameters[: len(vocabulary)], parameters[len(vocabulary)], np.exp(parameters[len(vocabulary) + 1 :])
        theta = first + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, w[flat], minlength=len(sets)) if len(flat) else np.zeros(len(sets))
        below = 1 / (1 + np.exp(np.clip(score[:, None] - theta, -50, 50)))
        padded = np.concatenate([np.zeros((len(y), 1)), below, np.ones((len(y), 1))], axis=1)
        slope = np.concatenate([np.zeros((len(y), 1)), below * (1 - below), np.zeros((len(y), 1))], axis=1)
        at = np.arange(len(y))
        likely = np.maximum(padded[at, y + 1] - padded[at, y], 1e-9)
        upper, lower = weight * slope[at, y + 1] / likely, weight * slope[at, y] / likely
        by_score = upper - lower  # gradient of the negative log likelihood by the score
        by_theta = np.zeros(top + 2)
        np.add.at(by_theta, y + 1, -upper)
        np.add.at(by_theta, y, lower)
        by_theta = by_theta[1:-1]
        tail = np.cumsum(by_theta[::-1])[::-1]
        gradient = np.concatenate([
            (np.bincount(flat, by_score[rows], minlength=len(vocabulary)) if len(flat) else np.zeros(len(vocabulary))) + penalty * w,
            tail[:1], tail[1:] * gaps,
        ])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        parameters = parameters - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        parameters[: len(vocabulary)] = np.maximum(parameters[: len(vocabulary)], 0)  # a cue never speaks for a text
    w, first, gaps = parameters[: len(vocabulary)], parameters[len(vocabulary)], np.exp(parameters[len(vocabulary) + 1 :])
    theta = first + np.concatenate([[0.0], np.cumsum(gaps)])
    return OrdinalModel({t: float(x) for t, x in zip(vocabulary, w, strict=True) if abs(x) > 1e-6}, tuple(map(float, theta)))


def graded(texts: list[str], toxic: list[int]) -> OrdinalModel:
    """A model of three grades from labels that only say toxic or not.

    0 is not toxic. A toxic document with more distinct cues than the middle toxic document has grade 2, any
    other grade 1. Without toxic documents nothing is severe.
    """
    sets = [features(t) for t in texts]
    known = set(cues(sets, toxic))
    doses = [len(s & known) for s in sets]
    middle = float(np.median([d for d, y in zip(doses, toxic, strict=True) if y] or [0]))
    return fitted(sets, [int(y) + int(bool(y) and d > middle) for d, y in zip(doses, toxic, strict=True)])


def sample_model(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> OrdinalModel:
    """The model of at most ``rows`` toxic and ``rows`` other labelled documents, those with the least hashes.

    The same rows are chosen whatever the partitioning. Rows without a label or text are not used.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.least("toxic", F.lit(1)).alias("y"))
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).withColumn("h", order).orderBy("h", "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text IS NOT NULL")
    # a repeated id may bring more rows than were chosen, so the bound is held here
    found = picked.orderBy("h", "doc_id", "text").limit(2 * rows).collect()
    return graded([r["text"] for r in found], [r["y"] for r in found])


def scored(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``__severity``, from whole texts. Null or empty text scores as no features."""
    # at most FEATURES words and numbers, as plain values: a broadcast is read by workers that may not have this package
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in sliced(batches):
            found = [severity(t.as_py(), *own) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.float64())], names=[*batch.schema.names[:-1], "__severity"]
            )

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], "__severity double"])
    return docs.withColumn("__text", F.col(text)).mapInArrow(score, schema)


def severities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity and toxic (rejected) of every row.

    Repeated rows score alike; an empty table gives an empty result; other columns are not read.
    """
    model = sample_model(docs, labels)
    found = scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.col("__severity").alias("severity"), (F.col("__severity") >= REJECT_AT).alias("toxic"))


def clean_documents(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The documents that are not rejected, with all their columns; ``labelled`` holds the texts to fit on."""
    model = sample_model(docs if labelled is None else labelled, labels)
    return scored(docs, model).filter(F.col("__severity") < REJECT_AT).select(*docs.columns)
