"""Phrases of two to five words that occur together more often than by chance.

A phrase that occurs ``least`` times is found without counting all phrases. Their 64-bit hashes are dealt out
to partitions; a Misra-Gries summary of each, whose capacity exceeds the partition's mass divided by ``least``, keeps
every frequent one. Summaries merge, so every task sends what it has counted in a block. A second pass over the texts
counts the survivors exactly, by the phrases themselves.

Longer phrases are summarised after pairs: a phrase is frequent only if its words and its pairs are. What is frequent
travels to the tasks as a bitmap of fixed size, which may let more through but never less.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentrace.llm.common import released, text_or_empty, written
from lumentrace.plans.skew import join_per_key

LEAST, LONGEST, TOP = 100, 5, 2000
#: Stands for a null language.
NO_LANG = "und"
#: Bytes of text that are cut into words at once.
BLOCK_BYTES = 1 << 20
#: Distinct phrases a task gathers before it sends them, and hashes in a row that it sends.
HELD, ROW_HASHES = 2_000_000, 1024
HELD_TEXTS = 200_000
#: Occurrences of phrases for one hash partition at most, on average.
PARTITION_MASS = 50_000_000
#: Bits of the bitmaps that tell tasks what is frequent: 16 MB.
BITS = 1 << 27

_C = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_KIND = np.zeros(256, np.int8)  # 0: in a word, 1: between words, 2: between pieces
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_BYTE = np.random.default_rng(12).integers(0, 2**64, 256, np.uint64, endpoint=False)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """The words of some texts: where they are, their hashes, and their pieces. Phrases lie within a piece."""

    def __init__(self, texts: Sequence[bytes], langs: Sequence[str]) -> None:
        self.text = b"\n".join(texts).lower()
        raw = np.frombuffer(self.text, np.uint8)
        kind = _KIND[raw]
        flags = np.zeros(len(raw) + 2, np.int8)
        flags[1:-1] = kind == 0
        edges = np.flatnonzero(np.diff(flags))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.piece = np.cumsum(kind == 2)[self.starts] if len(raw) else self.starts
        up, down = (_powers(len(raw), base) for base in (_BASE, pow(_BASE, -1, 2**64)))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64, out=sums[1:])
        self.words = _mix((sums[self.ends] - sums[self.starts]) * down[self.starts])
        self.langs = langs
        firsts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        self.row = np.searchsorted(firsts, self.starts, "right") - 1
        self.lang = np.array([lang_hash(x) for x in langs], np.uint64)[self.row]

    def phrases(self, sizes: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, hash at every word, whether that many words from there are in one piece) for each of ``sizes``."""
        hashes = self.lang
        for n in range(1, max(sizes) + 1):
            held = len(self.words) - n + 1
            if held <= 0:
                return
            hashes = _mix(hashes[:held] * _C + self.words[n - 1 :])
            if n in sizes:
                yield n, hashes, self.piece[n - 1 :] == self.piece[:held]

    def phrase(self, at: int, n: int) -> str:
        where = zip(self.starts[at : at + n].tolist(), self.ends[at : at + n].tolist(), strict=True)
        return b" ".join([self.text[a:b] for a, b in where]).decode()


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    held = _POWERS.get(base, np.zeros(0, np.uint64))
    if len(held) < n:
        held = np.full(max(n, 2 * len(held)), base, np.uint64)
        held[0] = 1
        _POWERS[base] = held = np.cumprod(held, dtype=np.uint64)
    return held


def lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of about BLOCK_BYTES from rows (text, lang). A long text is cut where a piece ends, which cuts no phrase."""
    for batch in batches:
        held: list[bytes] = []
        langs: list[str] = []
        size = 0
        for text, lang in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
            rest = text.as_py()
            while rest:
                part = rest
                if len(rest) > BLOCK_BYTES:
                    ends = np.flatnonzero(_KIND[np.frombuffer(rest, np.uint8, offset=BLOCK_BYTES)] == 2)
                    part = rest[: BLOCK_BYTES + int(ends[0]) + 1] if len(ends) else rest
                rest = rest[len(part) :]
                if held and size + len(part) > BLOCK_BYTES:
                    yield Block(held, langs)
                    held, langs, size = [], [], 0
                held.append(part)
                langs.append(lang)
                size += len(part)
        if held:
            yield Block(held, langs)


def among(bitmap: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set."""
    at = hashes & np.uint64(BITS - 1)
    bits = np.frombuffer(bitmap, np.uint8)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap_of(found: DataFrame) -> bytes:
    """BITS bits, those of the hashes in ``found`` set: as many bytes at any size of the input.

    Parts of 32,768 bits are made by aggregates; the driver only puts them in place.
    """
    at = F.col("h").bitwiseAND(F.lit(BITS - 1)) + 1
    parts = found.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m"))
    out = bytearray(BITS // 8)
    for row in parts.collect():  # 4,096 rows of 4 KB at most
        out[(row.b - 1) * 4096 : row.b * 4096] = row.m
    return bytes(out)


class Summary:
    """A Misra-Gries summary: at most ``capacity`` counters; none is lower than the truth by more than ``taken``.

    ``taken`` is at most mass / (capacity + 1). Counts are added in bulk; whenever there are too many counters, the
    largest count beyond the capacity is taken from all of them. Adding the counters of another summary (and its
    ``taken``) merges the two.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.taken = capacity, 0
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, hashes: np.ndarray, counts: np.ndarray, taken: int = 0) -> None:
        both = np.concatenate([self.hashes, hashes])
        order = np.argsort(both, kind="stable")
        both = both[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(both)), bool), both[1:] != both[:-1]]))
        counts = np.add.reduceat(np.concatenate([self.counts, counts])[order], first) if len(first) else self.counts
        self.hashes, self.counts, self.taken = both[first], counts, self.taken + taken
        if len(counts) > self.capacity:
            cut = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            left = counts > cut
            self.hashes, self.counts, self.taken = self.hashes[left], counts[left] - cut, self.taken + cut

    def frequent(self, least: int) -> np.ndarray:
        """The hashes that may occur ``least`` times; all that do are among them if capacity + 1 > mass / least."""
        return self.hashes[self.counts + self.taken >= least]


def _chosen(block: Block, sizes: Sequence[int], words: bytes | None, pairs: bytes | None) -> Iterator[np.ndarray]:
    """Hashes of the phrases of ``sizes`` whose words, or whose pairs, are all in the bitmap given."""
    parts = 1 if pairs is None else 2
    inner = None
    if len(block.words) >= parts:
        (_, hashes, _), = block.phrases([parts])
        inner = among(words if pairs is None else pairs, hashes)
    for n, hashes, whole in block.phrases(sizes):
        held = whole
        for i in range(n - parts + 1):
            held = held & inner[i : i + len(hashes)]
        yield hashes[held]


def summarised(docs: DataFrame, sizes: Sequence[int], least: int, mass: int, words: bytes | None = None, pairs: bytes | None = None) -> DataFrame:
    """Hashes ``h`` of phrases of ``sizes`` words (text and lang of ``docs``), among them all that occur ``least`` times.

    ``mass`` is at least the number of words; it only decides into how many partitions the hashes are dealt.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-mass * len(sizes) // PARTITION_MASS))
    shared = spark.sparkContext.broadcast((words, pairs))

    def sent(hashes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows (part, kind, data): first the mass of each partition, then its hashes with their counts."""
        part = (hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        bounds = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        for p in np.flatnonzero(np.diff(bounds)).tolist():
            a, b = int(bounds[p]), int(bounds[p + 1])
            at = range(a, b, ROW_HASHES)
            total = np.array([counts[a:b].sum()]).tobytes()
            data = [hashes[i : min(i + ROW_HASHES, b)].tobytes() + counts[i : min(i + ROW_HASHES, b)].tobytes() for i in at]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p] * (len(data) + 1), pa.int32()), pa.array([0] + [1] * len(data), pa.int32()), pa.array([total, *data], pa.binary())],
                names=["part", "kind", "data"],
            )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Summary(2**62)
        waiting: list[np.ndarray] = []

        def settle() -> None:
            new, counts = np.unique(np.concatenate(waiting), return_counts=True)
            held.add(new, counts)
            waiting.clear()

        for block in blocks(batches):
            waiting.extend(_chosen(block, sizes, *shared.value))
            if sum(map(len, waiting)) >= HELD:
                settle()
                if len(held.hashes) >= HELD:
                    yield from sent(held.hashes, held.counts)
                    held = Summary(2**62)
        if waiting:
            settle()
        yield from sent(held.hashes, held.counts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary = -1, 0, None
        waiting: list[np.ndarray] = []

        def settle() -> None:
            if waiting:
                rows = [np.frombuffer(x, np.uint64) for x in waiting]
                summary.add(np.concatenate([r[: len(r) // 2] for r in rows]), np.concatenate([r[len(r) // 2 :].view(np.int64) for r in rows]))
                waiting.clear()

        def out() -> pa.RecordBatch:
            settle()
            found = summary.frequent(least) if summary else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["h"])

        for batch in batches:
            for p, kind, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if p != part:
                    if summary:
                        yield out()
                    part, mass, summary = p, 0, None
                if kind == 0:
                    mass += int(np.frombuffer(data, np.int64)[0])
                    continue
                summary = summary or Summary(mass // least + 1)
                waiting.append(data)
                if len(waiting) * ROW_HASHES > max(summary.capacity, 1 << 18):
                    settle()
        if summary:
            yield out()

    rows = docs.mapInArrow(gather, "part int, kind int, data binary")
    dealt = rows.repartition(parts, "part").sortWithinPartitions("part", "kind")
    return dealt.mapInArrow(merge, "h long")


def counted(docs: DataFrame, sizes: Sequence[int], bitmap: bytes | None = None) -> DataFrame:
    """lang, phrase, h and a (occurrences) of the phrases of ``sizes`` words whose hash is in the bitmap, if one is given."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def sent() -> pa.RecordBatch:
            rows = list(held.values())
            h = np.fromiter(held.keys(), np.uint64, len(held)).view(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array(h), pa.array([r[2] for r in rows], pa.int64())],
                names=["lang", "phrase", "h", "a"],
            )

        for block in blocks(batches):
            for n, hashes, whole in block.phrases(sizes):
                at = np.flatnonzero(whole if shared.value is None else whole & among(shared.value, hashes))
                new, first, many = np.unique(hashes[at], return_index=True, return_counts=True)
                for h, i, c in zip(new.tolist(), at[first].tolist(), many.tolist(), strict=True):
                    if h in held:
                        held[h][2] += c
                    else:
                        held[h] = [block.langs[block.row[i]], block.phrase(i, n), c]
            if len(held) >= HELD_TEXTS:
                yield sent()
        if held:
            yield sent()

    rows = docs.mapInArrow(count, "lang string, phrase string, h long, a long")
    return rows.groupBy("lang", "phrase").agg(F.first("h").alias("h"), F.sum("a").alias("a"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k words, a) of every phrase of one to ``longest`` words that occurs ``least`` times, and (lang, n) with the words of each lang.

    Both are written tables; counts are exact and cover all texts.
    """
    rows = docs.select(text_or_empty().alias("text"), F.coalesce("lang", F.lit(NO_LANG)).alias("lang"))
    vocabulary = written(counted(rows, [1]), "vocabulary")
    sums = written(vocabulary.groupBy("lang").agg(F.sum("a").alias("n")), "sums")
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = written(vocabulary.filter(F.col("a") >= least), "words")
    released(vocabulary)
    pairs = written(summarised(rows, [2], least, total, words=bitmap_of(words)), "pairs")
    survivors = [pairs]
    if longest > 2:
        survivors.append(written(summarised(rows, range(3, longest + 1), least, total, pairs=bitmap_of(pairs)), "more"))
    exact = counted(rows, range(2, longest + 1), bitmap_of(reduce(DataFrame.unionByName, survivors))).filter(F.col("a") >= least)
    out = written(words.unionByName(exact).withColumn("k", F.size(F.split("phrase", " "))).drop("h"), "phrases")
    for table in (words, *survivors):
        released(table)
    return out, sums


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(20,0)")


def scored(found: DataFrame, sums: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n and score of every phrase of two or more words, by the cut with the lowest score.

    Cutting after k words leaves parts with l and r occurrences; the score is floor(1000 * a * n / (l * r)), in
    whole numbers of 38 digits. Ties go to the smallest k. Parts are frequent whenever the phrase is, so their counts
    are in ``found``.
    """
    parts = found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    many = found.filter("k > 1").withColumn("w", F.split("phrase", " "))
    cuts = many.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("cut"))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("cut") + 1, F.size("w")), " ").alias("tail"),
    )
    for part, count in (("head", "l"), ("tail", "r")):
        cuts = join_per_key(cuts, parts.withColumnsRenamed({"part": part, "f": count}), ["lang", part], spread=["phrase", "cut"], estimated=True)
    cuts = join_per_key(cuts, sums, ["lang"], spread=["phrase", "cut"], estimated=True)
    whole = (F.lit(1000).cast("decimal(4,0)") * (_exact("a") * _exact("n")).cast("decimal(34,0)")).cast("decimal(38,0)")
    cuts = cuts.withColumns({"over": whole, "under": (_exact("l") * _exact("r")).cast("decimal(38,0)")})
    cuts = cuts.withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    return best.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases of 2 to ``longest`` words.

    Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into words ``[^\\x20\\x09]+``. A phrase
    that occurs as often as a longer one around it is left out. Order: score and a descending, then the
    phrase's bytes. Null text is empty; a null lang counts as ``und``; repeated rows count each; an empty table
    gives an empty result; only text and lang are read.
    """
    found, sums = frequent_phrases(docs, least, longest)
    w = F.split("phrase", " ")
    shorter = found.filter("k > 2").select(
        "lang", F.explode(F.array(F.slice(w, F.lit(1), F.col("k") - 1), F.slice(w, F.lit(2), F.col("k") - 1))).alias("s"), F.col("a").alias("f")
    )
    # a phrase inside a longer one is inside one with one more word, which occurs at least as often
    around = shorter.groupBy("lang", F.array_join("s", " ").alias("phrase")).agg(F.max("f").alias("f"))
    alone = scored(found, sums).join(around, ["lang", "phrase"], "left").filter(F.isnull("f") | (100 * F.col("f") < 100 * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = alone.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
