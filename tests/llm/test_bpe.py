"""Ids against the library that owns the rank format; decoding is an exact round trip."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from lumentrace.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(PATH), special_tokens={})


def fuzz(n, seed):
    rnd = random.Random(seed)
    pool = list("ab1'sd .,!?     \t\n\r\x0b\x0c\xa0　 \x1c\x85éß中文🙂👩‍👩‍👧ǅ½") + ["'s", "don't", " a", "<|endoftext|>", "word "]
    return ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_query(spark, documents, odd, nothing, plain):
    texts = fuzz(300, 1)
    rows = spark.createDataFrame(list(enumerate(texts, 10**6)), "doc_id long, text string")
    for df in (documents, odd, rows):
        want = sorted((str(r["doc_id"]), r["text"] or "") for r in df.select("doc_id", "text").collect())
        got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(df, PATH, P.PATTERN).collect())
        made = sorted(
            (d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
            for d, t in want for ids in [plain.encode_ordinary(t)]
        )
        assert got == made
    assert bpe.round_trip(nothing, PATH, P.PATTERN).count() == 0


def test_forgetting(plain, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    worker, texts = bpe.Encoder(PATH, P.PATTERN), fuzz(200, 2)
    for i in range(0, 200, 20):
        ids, counts = worker.ids(texts[i : i + 20])
        assert ids.tolist() == [x for t in texts[i : i + 20] for x in plain.encode_ordinary(t)]
        assert counts.tolist() == [len(plain.encode_ordinary(t)) for t in texts[i : i + 20]]


def test_offsets(spark, plain):
    texts = fuzz(100, 3) + ["🙂 中文 é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encoded(df, PATH, P.PATTERN, offsets=True).collect():
        ids, raw = plain.encode_ordinary(r["text"]), r["text"].encode()
        assert r["__ids"] == ids
        at, owner = 0, [i for i, c in enumerate(r["text"]) for _ in c.encode()]
        for token, a, b in zip(ids, r["__starts"], r["__ends"]):
            n = len(plain.decode_single_token_bytes(token))
            touched = owner[at : at + n]
            assert a <= touched[0] and touched[-1] < b, (r["text"], token)
            at += n
        assert at == len(raw)


def test_pieces(plain):
    for text in fuzz(100, 4) + ["👩‍👩‍👧 中文"]:
        ids = plain.encode_ordinary(text)
        assert "".join(bpe.pieces(ids, PATH)) == text
    assert "".join(bpe.pieces(plain.encode_ordinary("𒀀")[:1], PATH)) == "�"


def test_unknown_id(spark):
    tokens = spark.createDataFrame([([10**6],)], "`__ids` array<int>")
    with pytest.raises(Exception, match="byte table"):
        bpe.decoded(tokens, PATH).collect()
    assert bpe.decoded(spark.createDataFrame([(None,), ([],)], "`__ids` array<int>"), PATH).collect()[0]["__bytes"] is None
