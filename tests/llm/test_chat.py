import hashlib
import json
import random


from lumentrace.llm import chat as C


def fuzz(n):
    rnd = random.Random(5)
    pool = [C.TURN, C.TEXT, C.END, "<", "|", "\\", ">", "\n", "a", "é🙂", "<\\|", "<|", "assistant"]
    return ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        turns = [(r, x) for *_, r, x in mine]
        loss = "".join(x for r, x in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r[0]: tuple(r)[1:5] for r in C.conversation_digests(df).collect()}
    assert got == brute(rows)


def test_round_trip(spark):
    texts = fuzz(400)
    rnd = random.Random(6)
    check(spark, [(i // 7, i % 7, rnd.choice(["user", "assistant", "system"]), t) for i, t in enumerate(texts)])


def test_odd_rows(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, None, "user", None), (1, 0, None, "x"), (1, 0, None, "x"), (None, 1, "assistant", "y"),
            (2, 1, "assistant", "b"), (2, 0, "assistant", "a"), (3, 0, C.END, C.TEXT), (4, 5, "assistant", "long " * 50_000), (5, 0, "human", "x"), (5, 1, "gpt", "y")]
    check(spark, rows)
    check(spark, [(8, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(3000)] + [(9, 0, "user", "z")])
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.conversation_digests(empty).count() == 0


def test_control_strings_only_where_the_template_puts_them(spark):
    texts = fuzz(200)
    df = spark.createDataFrame([(i, 0, 0, "assistant", t) for i, t in enumerate(texts)], "key long, at long, pos int, role string, text string")
    for r in C.read_back(C.formatted(df)).collect():
        assert r["text"] == r["loss"] == texts[r["key"]]
        assert [r["piece"].count(m) for m in (C.TURN, C.TEXT, C.END)] == [1, 1, 1] and r["piece"].count("<|") == 3


LAYOUTS = {
    "prompt": ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    "system_prompt": ({"system": "s", "prompt": "p", "completion": None}, [("system", "s"), ("user", "p"), ("assistant", "")]),
    "instruction": ({"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    "instruction_input": ({"output": "o", "input": "x", "instruction": "i"}, [("system", "i"), ("user", "x"), ("assistant", "o")]),
    "messages": ({"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]}, [("user", "a"), ("assistant", "b")]),
    "conversations": ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
}


def test_layouts(spark):
    assert set(LAYOUTS) == set(C.LAYOUTS) and len(C.MAPPINGS) == len(C.LAYOUTS)
    rows = [(i, json.dumps(v)) for i, (v, _) in enumerate(LAYOUTS.values())]
    got = C.turns(spark.createDataFrame(rows, "id long, record string"), "id", "record").orderBy("key", "pos").collect()
    assert [(r["key"], r["role"], r["text"]) for r in got] == [(i, *t) for i, (_, ts) in enumerate(LAYOUTS.values()) for t in ts]


ODD = {
    None: ("empty", []), "null": ("empty", []), "{}": ("empty", []), '{"messages": []}': ("empty", []), '{"conversations": [], "id": 7}': ("empty", []),
    '{"question": "?", "answer": {"text": "!"}}': (None, []), "no json": (None, []), "[1, 2]": (None, []), '"text"': (None, []),
    '{"messages": [{"role": "user", "content": "a", "name": "n"}], "id": 3}': ("messages", [("user", "a")]),
    '{"prompt": null, "completion": "c", "meta": {"x": [1]}}': ("prompt", [("user", ""), ("assistant", "c")]),
    '{"messages": [{"role": "user", "content": "a"}, {"content": 5}]}': ("messages", [("user", "a"), ("", "5")]),
}


def test_null_empty_unknown_and_extended_records(spark):
    rows = [(i, r, "clash", 9) for i, r in enumerate(ODD)]
    df = spark.createDataFrame(rows, "id long, record string, role string, pos int").repartition(3)
    named = {r["id"]: r["__layout"] for r in C.layouts(df, "record").collect()}
    assert named == {i: name for i, (name, _) in enumerate(ODD.values())}
    got = C.turns(df, "id", "record").orderBy("key", "pos").collect()
    assert [(r["key"], r["role"], r["text"]) for r in got] == [(i, *t) for i, (_, ts) in enumerate(ODD.values()) for t in ts]
    assert C.turns(df.filter("false"), "id", "record").count() == 0


def test_query_ignores_clashing_columns(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = rows.selectExpr("*", "1 AS key", "2 AS at", "'x' AS piece", "3 AS loss", "4 AS n_turns")
    want, got = (sorted(map(tuple, C.conversation_digests(df).collect())) for df in (rows, extra))
    assert got == want


def test_field_paths():
    assert C.field_paths({"a": [{"b": 1}, {"c": {"d": []}}], "e": {}}) == {"a[].b", "a[].c.d[]", "e"}
