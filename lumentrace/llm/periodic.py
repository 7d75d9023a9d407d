"""Runs of words that repeat with a period, found exactly by multi-scale minimizers.

Short periods are found by comparing the words with those a fixed lag later. A scale serves the periods from
``low`` up to ``high``. Its grams are ``high`` words long, so inside a run of such a period q two equal grams lie a
multiple of q apart; its windows are so short that a run of three periods holds one whole window whose
copy, q words later, also lies in the run. A window and its copy have the same minimum, hence the run shows a pair
of minimizers with equal grams, q apart and with no such gram in between. Pairs of that kind whose distance
belongs to the scale are seeds; comparing words to both sides of a seed gives the longest stretch of its period.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrace.functions.arrays import let
from lumentrace.llm.common import text_or_empty, words

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Periods up to this one are found by lag scans.
LAGS = 8
#: Bytes of text that are searched at once; a longer text is searched alone.
SLICE_BYTES = 4 << 20

_C = np.uint64(0x9E3779B97F4A7C15)
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def scales(longest: int) -> Iterator[tuple[int, int]]:
    """(lowest, highest) period of each scale, up to the longest period that a text of so many words can have."""
    low = LAGS + 1
    while LEAST_PERIODS * low <= longest:
        high = low + low // 4
        yield low, high
        low = high + 1


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``width`` neighbours, by doubling."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = best(out[: len(out) - step], out[step:])
        done += step
    return out


def grams(codes: np.ndarray, hashes: dict[int, np.ndarray], size: int) -> np.ndarray:
    """Hash of every ``size`` neighbours, from two overlapping ones of a power of two. ``hashes`` keeps the last power."""
    power = max(hashes)
    while 2 * power <= size:
        held = hashes.pop(power)
        hashes[2 * power] = _mix(held[:-power] * _C + held[power:])
        power *= 2
    held = hashes[power]
    n = len(codes) - size + 1
    return _mix(held[:n] * _C + held[size - power : size - power + n]) if size > power else held


def seeds(codes: np.ndarray, hashes: dict[int, np.ndarray], low: int, high: int) -> Iterator[tuple[int, int]]:
    """(position, period) of equal minimizers in a row, by period and position."""
    values = grams(codes, hashes, high)
    width = 2 * low - high + 1
    if len(values) < width:
        return
    least = sliding(values, width, np.minimum)
    wide = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero(sliding(wide, width, np.maximum) == values)
    order = chosen[np.argsort(values[chosen], kind="stable")]
    gap = np.diff(order)
    found = (values[order[1:]] == values[order[:-1]]) & (gap >= low) & (gap <= high)
    at, period = order[:-1][found], gap[found]
    by = np.lexsort((at, period))
    yield from zip(at[by].tolist(), period[by].tolist(), strict=True)


def _first_difference(a: np.ndarray, b: np.ndarray) -> int:
    """Leading equal elements of two arrays, looking at twice as many each time."""
    n, start, step = min(len(a), len(b)), 0, 64
    while start < n:
        same = a[start : min(start + step, n)] == b[start : min(start + step, n)]
        if not same.all():
            return start + int(np.argmin(same))
        start, step = start + step, 2 * step
    return n


def stretch(codes: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """(start, end) of the words around ``at`` that equal those ``period`` later; the last period is included."""
    right = _first_difference(codes[at:], codes[at + period :])
    left = _first_difference(codes[:at][::-1], codes[: at + period][::-1])
    return at - left, at + right + period


def runs_of(codes: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, in order, in texts that follow each other, longest first.

    ``codes`` of different texts differ. Grams are told apart by 64-bit hashes, words are compared themselves.
    """
    found: dict[tuple[int, int], int] = {}

    def add(start: int, end: int, period: int) -> None:
        if end - start >= max(LEAST_WORDS, LEAST_PERIODS * period):
            key = (start, end - start)
            found[key] = min(period, found.get(key, period))

    ends = np.cumsum(lengths)
    for lag in range(1, LAGS + 1):
        flags = np.zeros(max(len(codes) - lag, 0) + 2, np.int8)
        flags[1:-1] = codes[lag:] == codes[:-lag] if len(codes) > lag else 0
        edges = np.flatnonzero(np.diff(flags))
        enough = edges[1::2] - edges[::2] + lag >= LEAST_WORDS
        for start, end in zip(edges[::2][enough].tolist(), (edges[1::2][enough] + lag).tolist(), strict=True):
            add(start, end, lag)
    hashes = {1: _mix(codes.astype(np.uint64))}
    for low, high in scales(int(lengths.max(initial=0))):
        held = int(ends[np.count_nonzero(lengths >= LEAST_PERIODS * low) - 1])  # shorter texts have no such period
        codes, hashes = codes[:held], {k: h[: held - k + 1] for k, h in hashes.items()}
        last = (0, 0)
        for at, period in seeds(codes, hashes, low, high):
            if last[0] != period or at >= last[1] - period:
                start, end = stretch(codes, at, period)
                last = (period, end)
                add(start, end, period)
    return sorted((start, length, period) for (start, length), period in found.items())


class _Codes(dict):
    def __missing__(self, key: bytes) -> int:
        self[key] = code = len(self)
        return code


def _searched(texts: list[bytes]) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """The runs of each text, and its words without the repetitions."""
    found = [text.split() for text in texts]  # of bytes: at any of the six white-space bytes
    lengths = np.array([len(w) for w in found], np.int64)
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    known = _Codes()
    codes = np.fromiter((known[w] for i in order for w in found[i]), np.int64, int(lengths.sum()))
    codes = codes * len(texts) + np.repeat(np.arange(len(texts)), lengths)
    firsts = np.cumsum(lengths) - lengths
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    gone = np.zeros(len(codes) + 1, np.int64)
    for start, length, period in runs_of(codes, lengths):
        k = int(np.searchsorted(firsts, start, "right")) - 1
        runs[order[k]].append((start - int(firsts[k]), length, period))
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = np.cumsum(gone[:-1]) == 0
    short: list[bytes] = [b""] * len(texts)
    for k, i in enumerate(order.tolist()):
        mine = kept[firsts[k] : firsts[k] + lengths[k]]
        left = found[i] if mine.all() else [w for w, stays in zip(found[i], mine.tolist(), strict=True) if stays]
        short[i] = b" ".join(left)
    return runs, short


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs``, ``__runs`` (start, length and period in words, in order) and ``__collapsed``.

    A run is a stretch of consecutive words with smallest period q (words q apart are equal) and at least
    max(24, 3 q) words that no neighbouring word extends. ``__collapsed`` keeps the words that no run contains
    after its first q words, joined by one space. Null, empty and blank texts have no runs and collapse to an empty
    text. Rows are judged one by one, so repeated rows get equal results; an empty table gives an empty
    result; other columns pass through (names starting with ``__`` are reserved).
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            sizes = pc.binary_length(texts).to_numpy()
            start = 0
            while start < len(texts):
                within = int(np.searchsorted(np.cumsum(sizes[start:]), SLICE_BYTES, "right"))
                end = start + max(1, within)
                runs, short = _searched(texts.slice(start, end - start).to_pylist())
                rows = batch.slice(start, end - start)
                listed = [[{"start": s, "length": n, "period": p} for s, n, p in found] for found in runs]
                columns = [pa.array(listed, pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))),
                           pa.array(short, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *columns], names=[*rows.schema.names[:-1], "__runs", "__collapsed"])
                start = end

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], f"__runs array<{RUN}>", "__collapsed string"])
    return docs.withColumn("__text", text_or_empty(text)).mapInArrow(search, schema)


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with most periods, exactly; of equal ones the first, then that of the smallest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _strongest(runs: Column) -> Column:
    """As :func:`strongest`, for a column of runs in order; null if there is none."""

    def better(best: Column, run: Column) -> Column:
        return F.when(F.isnull(best) | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and the text of every row, where one row in ten (by crc32 of its doc_id) goes on with a period.

    With h the checksum and g = h // 10, the n words from a = g % n on become copies of the first
    1 + (n - a) // (3 + g % 8) of them. Rows with a null doc_id, and those without words, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def tail(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i).cast("int"))), " ")

    text = text_or_empty()
    edited = F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), let(words(text), tail))
    return docs.select("doc_id", F.coalesce(edited, text).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run and digests of all runs and of the collapsed text, one row per document.

    Nulls, empty texts, repeated rows and empty tables are treated as in :func:`with_runs`; a document without a run
    has nulls for the strongest one. Only doc_id and text are read.
    """
    found = with_runs(repeated_tails(docs)).withColumn("__best", _strongest(F.col("__runs")))
    line = F.transform("__runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("__runs").cast("long").alias("n_runs"), "__best.start", "__best.length", "__best.period",
        F.floor(1000 * F.col("__best.length") / F.col("__best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("__collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
