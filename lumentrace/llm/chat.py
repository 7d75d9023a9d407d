"""Chat formatting: layouts are told apart by their field paths, mapped to turns, and written in one template.

A record is JSON text. The sorted paths of its fields (array positions left out) are hashed to a fingerprint;
a table of declarative mappings, one per fingerprint, says where the turns are. Turns are formatted as

    <|turn|>ROLE<|text|>TEXT<|end|>

and any ``<|`` inside a role or text is escaped by a backslash between its two characters, so that control
strings occur only where the template puts them. The escape is undone by taking one backslash away.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrace.llm.common import sliced

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Where turns are in each layout: (role, path) for single fields, or the array with its role and text fields,
#: and the names of roles. Layouts are given by the paths of their leaves.
LAYOUTS: dict[str, dict] = {
    "prompt": {"paths": ["completion", "prompt"], "turns": [("user", "prompt"), ("assistant", "completion")]},
    "system_prompt": {
        "paths": ["completion", "prompt", "system"],
        "turns": [("system", "system"), ("user", "prompt"), ("assistant", "completion")],
    },
    "instruction": {"paths": ["instruction", "output"], "turns": [("user", "instruction"), ("assistant", "output")]},
    "instruction_input": {
        "paths": ["input", "instruction", "output"],
        "turns": [("system", "instruction"), ("user", "input"), ("assistant", "output")],
    },
    "messages": {"paths": ["messages[].content", "messages[].role"], "list": ("messages", "role", "content")},
    "conversations": {
        "paths": ["conversations[].from", "conversations[].value"],
        "list": ("conversations", "from", "value"),
        "roles": {"human": "user", "gpt": "assistant"},
    },
}


def field_paths(value: object, path: str = "") -> set[str]:
    """Paths of all leaves; items of an array share one path. An empty array or object is a leaf."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{path}.{k}" if path else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(field_paths(v, path + "[]") for v in value))
    return {path + "[]" if isinstance(value, list) else path}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


MAPPINGS = {fingerprint(v["paths"]): (k, v) for k, v in LAYOUTS.items()}
#: Paths that any layout needs; other fields of a record are extras and don't count for its fingerprint.
_NEEDED = {p for v in LAYOUTS.values() for p in v["paths"]}
_LISTS = {v["list"][0] for v in LAYOUTS.values() if "list" in v}


def layout_of(record: str | None) -> str | None:
    """The layout of a record: a name in LAYOUTS, ``empty`` (null, no fields, or a list without messages), or None if it has none."""
    if record is None:
        return "empty"
    try:
        value = json.loads(record)
    except ValueError:
        return None
    return _layout(value)


def _layout(value: object) -> str | None:
    if value is None or value == {}:
        return "empty"
    if not isinstance(value, dict):
        return None
    needed = field_paths(value) & _NEEDED
    if not needed and any(value.get(name) == [] for name in _LISTS):
        return "empty"
    found = MAPPINGS.get(fingerprint(needed))
    return found[0] if found else None


def turns_of(record: str | None) -> list[tuple[str, str]]:
    """(role, text) turns of a JSON record. Null and empty records, those of no known layout and text that is no JSON have none.

    The fingerprint is that of the fields that layouts need, so a record may have more fields. A message without a role or text has
    an empty one; text that is not a string is written as JSON.
    """
    name = layout_of(record)
    if name in (None, "empty"):
        return []
    value, mapping = json.loads(record), LAYOUTS[name]
    if "list" in mapping:
        field, role, text = mapping["list"]
        items = [m if isinstance(m, dict) else {text: m} for m in value[field]]
        found = [(m.get(role), m.get(text)) for m in items]
    else:
        found = [(role, value[field]) for role, field in mapping["turns"]]
    names = mapping.get("roles", {})
    plain = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x)
    return [(names.get(plain(r), plain(r)), plain(t)) for r, t in found]


def layouts(records: DataFrame, record: str) -> DataFrame:
    """All columns of ``records`` and ``__layout`` (see :func:`layout_of`), so that unknown ones (null) can be counted."""

    at = records.columns.index(record)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [layout_of(r) for r in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "__layout"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema], "__layout string"])
    return records.mapInArrow(name, schema)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def turns(records: DataFrame, key: str, record: str, order: str | None = None) -> DataFrame:
    """(key, pos, role, text): the canonical turns of every record; records without turns (:func:`turns_of`) give no row.

    A conversation in several records (pieces of a long one) gives ``order``; the turns of a record follow
    those of the records before it.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [turns_of(r) for r in batch.column(2).to_pylist()]
            of = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            flat = [t for f in found for t in f]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(1).take(of), pa.array([i for f in found for i in range(len(f))], pa.int32()),
                 pa.array([r for r, _ in flat], pa.string()), pa.array([t for _, t in flat], pa.string())],
                names=["key", "at", "pos", "role", "text"],
            )

    kind = records.schema[key].dataType.simpleString()
    at = F.col(order).cast("long") if order else F.lit(0).cast("long")
    rows = records.select(F.col(key).alias("key"), at.alias("at"), F.col(record).alias("r"))
    return rows.mapInArrow(expand, f"key {kind}, at long, pos int, role string, text string")


def formatted(rows: DataFrame) -> DataFrame:
    """Turns with ``piece``, their formatted text, and ``loss_from`` and ``loss_to``: the code points of the
    piece that count for the loss (the text of an assistant, else nothing). A conversation is its pieces in order."""
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    body = escaped(F.col("text"))
    start = F.char_length(head)
    trained = F.when(F.col("role") == "assistant", F.char_length(body)).otherwise(0)
    return rows.withColumns({
        "piece": F.concat(head, body, F.lit(END)), "loss_from": start, "loss_to": start + trained,
    }).drop("role", "text")


def read_back(pieces: DataFrame) -> DataFrame:
    """Formatted pieces with ``role`` and ``text`` read from the control strings, and ``loss``, the text under the mask."""
    inner = F.expr(f"substring(piece, {len(TURN) + 1}, char_length(piece) - {len(TURN) + len(END)})")
    role = F.substring_index(inner, TEXT, 1)
    text = F.substring(inner, F.char_length(role) + len(TEXT) + 1, F.char_length(inner))
    loss = F.substring(F.col("piece"), F.col("loss_from") + 1, F.col("loss_to") - F.col("loss_from"))
    return pieces.withColumns({"role": unescaped(role), "text": unescaped(text), "loss": unescaped(loss)})


def digests(read: DataFrame) -> DataFrame:
    """One row per conversation, hashed turn by turn as its rows stream by in order."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, missing = None, object()
        key = missing

        def row() -> pa.RecordBatch:
            n, turns_hash, chars, loss_hash, size = state
            values = [[key], [n], [turns_hash.hexdigest()], [chars], [loss_hash.hexdigest()], [size]]
            kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            key_type, out = batch.column(0).type, []
            for k, role, text, loss, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key is missing or k != key:
                    if key is not missing:
                        out.append(row())
                    key, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += size
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if key is not missing:
            yield row()

    kind = read.schema["key"].dataType.simpleString()
    placed = read.repartition("key").sortWithinPartitions("key", "at", "pos", "role", "text")
    rows = placed.select("key", "role", "text", "loss", F.char_length("piece").alias("size"))
    return rows.mapInArrow(
        digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def records_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, record): each row of ``conversations`` as a JSON record in one of two message layouts.

    A row is a record of its own, so that no conversation, however long, has to fit one record.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    shared_role = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    item = lambda r, name, t: F.array(F.struct(r.alias(name), text.alias(t)))
    messages = F.to_json(F.struct(item(role, "role", "content").alias("messages")))
    shared = F.to_json(F.struct(item(shared_role, "from", "value").alias("conversations")))
    plain = (F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(2)) == 0) | role.isin("human", "gpt")
    layout = F.when(plain, messages).otherwise(shared)
    return conversations.select("conv_id", "turn", layout.alias("record"))


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted text.

    Turns go by ``turn`` (null first), equal turns by role and text; repeated rows are repeated turns; null
    role or text is empty; rows with a null conv_id are one conversation. An empty table gives an empty
    result; other columns are not read.
    """
    rows = turns(records_of(conversations), "conv_id", "record", "turn")
    return digests(read_back(formatted(rows)))
