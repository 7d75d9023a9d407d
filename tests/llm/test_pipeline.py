"""The stages against brute-force versions, each on what the stage before it kept."""

import hashlib
import re

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from lumentrace.llm import bpe, mixing, toxicity
from lumentrace.llm.common import written
from lumentrace.llm.queries import load
from tests.llm.test_ngram_join import brute
from tests.llm.test_quality import brute as brute_quality
from tools.check import compare, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def results(spark, sf, documents):
    out, docs = [documents], documents
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        out.append(docs)
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns(results, documents):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "ngram_jaccard_join", "mixing", "byte_bpe"]
    assert all(r.columns == documents.columns for r in results[:-1])


def test_quality_stage(results):
    assert ids(results[1]) == sorted(r["doc_id"] for r in results[0].collect() if not brute_quality(r["text"])[-1])


def test_toxicity_stage(results, spark, sf, documents):
    model = toxicity.sample_model(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids(results[2]) == sorted(r["doc_id"] for r in results[1].collect() if model.severity(r["text"]) < toxicity.REJECT_AT)


def test_near_duplicate_stage(results):
    rows = [(r["doc_id"], r["text"]) for r in results[2].collect()]
    assert ids(results[3]) == sorted(d for d, _, c in brute(rows, 5, 80) if c == d)
    texts = dict(rows)
    assert all(texts[r["doc_id"]] == r["text"] for r in results[3].collect())


def test_mixing_stage(results):
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(results[3]).collect() if r["taken"]}
    words, texts = {}, {r["doc_id"]: r["text"] for r in results[3].collect()}
    for r in results[4].collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
        assert r["text"] in texts[r["doc_id"]]
    assert words == taken


def test_token_stage(results):
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted(
        (r["doc_id"], len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())
        for r in results[4].collect() for x in [plain.encode_ordinary(r["text"])]
    )
    assert sorted(map(tuple, results[5].collect())) == want


def test_run_is_the_stages(spark, sf, results):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, results[-1].collect()))


QUERIES, ORACLES = load()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, name):
    ok, text = compare(connect(sf), QUERIES[name](spark, sf), ORACLES[name])
    assert ok, text


def test_odd_documents(spark, sf, odd, nothing):
    for docs in (odd, nothing):
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, sf), "odd")
        docs.count()
