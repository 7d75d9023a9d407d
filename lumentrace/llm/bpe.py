"""Byte-level BPE over Arrow batches: ids and character offsets, and decoding through the byte table."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrace.llm.common import sliced, text_or_empty

#: Characters given to the tokenizer at once.
SLICE_CHARS = 1 << 20
#: Distinct chunks a worker remembers before it starts anew.
REMEMBERED = 200_000
_UNUSUAL = re.compile(r"^ |\s | \s| $")


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The last merge that makes a token when only earlier ranks are merged; None for a single byte."""
    parts = [bytes([b]) for b in token]
    own = ranks[token]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], own))
        if ranks.get(parts[best] + parts[best + 1], own) >= own:
            raise ValueError(f"token {own} cannot be merged from earlier ones")
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str):
    """A tokenizer for a rank file; built once per Python worker."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    ranks, shown = ranks_of(path), byte_characters()
    text = lambda token: "".join(shown[b] for b in token)
    by_rank = sorted(ranks, key=ranks.__getitem__)
    merges = [(text(m[0]), text(m[1])) for t in by_rank if (m := merge_of(t, ranks))]
    made = Tokenizer(models.BPE(vocab={text(t): r for t, r in ranks.items()}, merges=merges))
    made.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    made.decoder = decoders.ByteLevel()
    return made


@lru_cache(maxsize=4)
def byte_table(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in ranks_of(path).items()}


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about SLICE_CHARS characters; a longer text is a range of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > SLICE_CHARS:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def gathered(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + length]`` of all codes, one after the other."""
    n = lengths[codes]
    ends = np.cumsum(n)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[codes] - ends + n, n)]


class _Codes(dict):
    """Numbers for strings in order of first sight."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = code = len(self)
        self.new.append(key)
        return code


class Encoder:
    """Ids of texts; the tokenizer sees each distinct chunk once while it is remembered.

    A single space between two characters that are no white space always begins a match of the pattern, so
    texts are cut there and a chunk is encoded with its space. A text with any other space next to white
    space, or at its ends, is encoded whole.
    """

    def __init__(self, path: str, pattern: str) -> None:
        self.made = tokenizer(path, pattern)
        self.forget()

    def forget(self) -> None:
        self.codes, self.flat = _Codes(), np.zeros(0, np.int32)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self) -> None:
        new = self.codes.new
        self.codes.new = []
        lengths, ids = [], []
        for i in range(0, len(new), 4096):
            part = [" " + c for c in new[i : i + 4096]]
            one = self.made.encode(part, is_pretokenized=True, add_special_tokens=False)
            lengths.append(np.bincount(np.array(one.word_ids, np.int64), minlength=len(part)))
            ids.append(np.array(one.ids, np.int32))
        if new:
            more = np.concatenate(lengths)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(more) - more])
            self.lengths, self.flat = np.concatenate([self.lengths, more]), np.concatenate([self.flat, *ids])

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if len(self.codes) > REMEMBERED:
            self.forget()
        plain = [not _UNUSUAL.search(t) for t in texts]
        chunks = [t.split(" ") if p else [] for t, p in zip(texts, plain, strict=True)]
        heads = [c.pop(0) if c else t for t, c in zip(texts, chunks, strict=True)]
        first = [np.array(e.ids, np.int32) for e in self.made.encode_batch_fast(heads, add_special_tokens=False)]
        counts = np.array([len(c) for c in chunks], np.int64)
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(chunks)), np.int64, int(counts.sum()))
        self.learn()
        rest = gathered(codes, self.starts, self.lengths, self.flat)
        per_chunk = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.lengths[codes])])
        bounds = per_chunk[np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])]
        both = [x for i, f in enumerate(first) for x in (f, rest[bounds[i] : bounds[i + 1]])]
        n = np.array([len(f) for f in first], np.int64) + np.diff(bounds)
        return (np.concatenate(both) if both else np.zeros(0, np.int32)), n


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder: what it remembers serves the worker's next tasks too."""
    return Encoder(path, pattern)


def _listed(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


class Decoder:
    """Bytes of ids, through the byte table."""

    def __init__(self, path: str) -> None:
        table = byte_table(path)
        tokens = [table.get(i, b"") for i in range(max(table) + 1)]
        self.lengths = np.array([len(x) for x in tokens], np.int64)
        self.flat, self.starts = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(self.lengths) - self.lengths

    def bytes_of(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("an id is not in the byte table")
        return gathered(ids, self.starts, self.lengths, self.flat).tobytes()


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False, back: bool = False) -> DataFrame:
    """All columns of ``docs`` and ``__ids``; with ``offsets`` also ``__starts`` and ``__ends``, with ``back`` also ``__bytes``,
    the ids decoded as :func:`decoded` does, by the worker that has them.

    Offsets are code points of the text. A character whose bytes lie in several tokens belongs to each of
    them. Null text counts as empty and has no ids. ``path`` is a rank file that every executor can read.
    """
    fields = ["__ids array<int>"] + ["__starts array<int>", "__ends array<int>"] * offsets + ["__bytes binary"] * back
    names = [f.split()[0] for f in fields]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = encoder(path, pattern)
        for batch in sliced(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in _slices(texts):
                if offsets:
                    found = worker.made.encode_batch(texts[a:b], add_special_tokens=False)
                    lists = [[e.ids for e in found], [[x for x, _ in e.offsets] for e in found], [[y for _, y in e.offsets] for e in found]]
                    columns = [pa.array(c, pa.list_(pa.int32())) for c in lists]
                else:
                    columns = [_listed(*worker.ids(texts[a:b]), pa.int32())]
                if back:
                    lists, table = columns[0], decoder(path)
                    each = [lists[i].values.to_numpy(zero_copy_only=False) for i in range(len(lists))]
                    columns.append(pa.array([table.bytes_of(ids) for ids in each], pa.binary()))
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *columns], names=[*rows.schema.names[:-1], *names])

    rows = docs.withColumn("__text", text_or_empty(text))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], *fields])
    return rows.mapInArrow(encode, schema)


def decoded(tokens: DataFrame, path: str, ids: str = "__ids") -> DataFrame:
    """All columns of ``tokens`` and ``__bytes``, the bytes of the ids joined.

    Joining bytes before they become characters is what restores characters split over tokens. An id that is
    not in the table is an error; null ids give null, no ids give no bytes.
    """
    at = tokens.columns.index(ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoder(path)
        for batch in sliced(batches):
            lists = batch.column(at)
            out = []
            for i in range(len(lists)):
                ids = lists[i].values
                out.append(None if ids is None else table.bytes_of(ids.to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "__bytes"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema], "__bytes binary"])
    return tokens.mapInArrow(decode, schema)


def pieces(ids: list[int], path: str) -> list[str]:
    """The text of each id in turn; a character split over ids comes whole with the id that ends it.

    Bytes that can be no character become U+FFFD. The pieces joined are the decoded text.
    """
    import codecs

    table, reader = byte_table(path), codecs.getincrementaldecoder("utf-8")("replace")
    out = [reader.decode(table[i]) for i in ids]
    if out:
        out[-1] += reader.decode(b"", True)
    return out


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row's whole text.

    Repeated rows give repeated results; other columns are not read; an empty table gives an empty result.
    """
    tokens = encoded(docs.select("doc_id", "text"), path, pattern, back=True)
    plain = F.array_join(F.col("__ids").cast("array<string>"), " ")
    return tokens.select(
        "doc_id", F.size("__ids").cast("long").alias("n_tokens"), F.sha2(plain.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("__bytes", 256).alias("decoded_sha256"),
    )
