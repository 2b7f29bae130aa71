"""Index, ranking, semantic and hybrid retrieval against plain Python."""

import collections
import json
import math
import os
import threading
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.config import RankParams, SemanticParams
from larkspur.operators.hybrid import SearchService
from larkspur.operators.index import LexicalIndex, from_texts, latest
from larkspur.operators.metrics import Registry, labelled_counts, latency_histogram
from larkspur.operators.rank import bm25, query_tokens, ranked
from larkspur.operators.semantic import SemanticIndex, embed_query, planes
from larkspur.plans import catalog
from larkspur.plans.api import answer, make_server, query_param

SCHEMA = "doc_id string, url string, title string, content string, tokens array<string>"
TEXTS = {
    "1": "vector search with vector vectors and raft",
    "10": "consensus raft raft consensus log",
    "2": "consensus raft raft consensus log",
    "3": "",
    "4": "the log of the search index the end",
    "5": "!!! ...",
    "6": "search search index and the vector log of a consensus",
}


def documents(spark, texts=TEXTS, tokens=None):
    rows = [(i, f"u{i}", f"t{i}", c, (tokens or {}).get(i)) for i, c in texts.items()]
    return spark.createDataFrame(rows, SCHEMA)


def py_bm25(texts, query, tokens=None):
    toks = {i: (tokens or {}).get(i) or query_tokens(c) for i, c in texts.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / max(len(toks), 1) or 1
    out = {}
    for t in query_tokens(query):
        df = sum(t in x for x in toks.values())
        if not df:
            continue
        idf = max(0.0, math.log((n - df + 0.5) / (df + 0.5)))
        for i, x in toks.items():
            if t in x:
                tf, dl = x.count(t), len(x) or avg
                out[i] = out.get(i, 0) + idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    return out


def py_cosines(texts, query, dim):
    q = embed_query(query, dim)
    out = {}
    for i, c in texts.items():
        v = embed_query(c, dim)
        both = math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in q))
        out[i] = sum(a * b for a, b in zip(v, q)) / both if both else 0.0
    return out


def order(scores, k):
    rows = sorted(((i, round(s, 6)) for i, s in scores.items()), key=lambda x: (-x[1], x[0]))
    return rows[:k] if k > 0 else rows


@pytest.mark.parametrize("query", ["consensus raft", "raft raft vector", "log", "unknown log", "unknown", "!!!", ""])
@pytest.mark.parametrize("k", [0, 1, 3, 50])
def test_bm25(spark, query, k):
    got = [tuple(r) for r in ranked(bm25(LexicalIndex.build(documents(spark)), query), k).collect()]
    assert got == order(py_bm25(TEXTS, query), k)


def test_supplied_tokens_rank(spark):
    tokens = {"3": ["Mixed", "raft"], "1": []}
    index = LexicalIndex.build(documents(spark, tokens=tokens))
    assert [tuple(r) for r in ranked(bm25(index, "raft"), 0).collect()] == order(py_bm25(TEXTS, "raft", tokens), 0)


def test_stored_index(spark, tmp_path):
    index = LexicalIndex.build(documents(spark)).save(str(tmp_path / "ix"))
    assert index.document_count() == 7 and index.document_frequency("raft") == 3 and index.document_frequency("no") == 0
    assert round(index.average_length(), 6) == round(sum(len(query_tokens(c)) for c in TEXTS.values()) / 7, 6)
    assert [tuple(r) for r in ranked(bm25(index, "raft log"), 0).collect()] == order(py_bm25(TEXTS, "raft log"), 0)
    assert {(r.doc_id, r.tf) for r in index.postings_for(["raft"]).collect()} == {("1", 1), ("10", 2), ("2", 2)}
    assert index.postings_for(["absent"]).count() == 0 and index.postings_for([]).count() == 0
    assert [r.doc_id for r in index.documents().collect()] == sorted(TEXTS)
    assert index.document("4").first()["doc_len"] == 8
    plan = index.postings_for(["raft"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tb" in plan and "EqualTo(term,raft)" in plan


def test_empty_collection(spark):
    docs = documents(spark, {})
    index = LexicalIndex.build(docs)
    assert index.document_count() == 0 and index.average_length() == 0
    assert SearchService(index, SemanticIndex.build(docs)).search("raft").collect() == []


def test_upsert(spark):
    df = spark.createDataFrame([("a", 1, "x y"), ("a", 3, ""), ("a", 2, "z"), ("b", 1, None)], "id string, v int, c string")
    assert {(r.id, r.v, r.c) for r in latest(df, "id", "v").collect()} == {("a", 3, ""), ("b", 1, None)}


def test_signatures(spark):
    p = SemanticParams(16, 8, 5)
    index = SemanticIndex.build(documents(spark), p)
    for r in index.vectors.collect():
        v = embed_query(TEXTS[r.doc_id], 16)
        assert r.vec == v
        assert r.sig == "".join("1" if sum(a * b for a, b in zip(v, q)) >= 0 else "0" for q in planes(p))
    assert index.vector("3").first()["sig"] == "1" * 8
    assert sum(r.docs for r in index.buckets().collect()) == 7
    assert index.reset().vectors.count() == 0


def py_candidates(texts, query, k, p):
    sig = lambda v: tuple(sum(a * b for a, b in zip(v, q)) >= 0 for q in planes(p))
    want = sig(embed_query(query, p.dimension))
    bucket = [i for i, c in texts.items() if sig(embed_query(c, p.dimension)) == want]
    if 0 < k and len(bucket) < k:
        bucket += sorted(texts)[: max(0, 5 * k - len(bucket))]
    return set(bucket)


@pytest.mark.parametrize("k", [-1, 0, 1, 2, 10])
@pytest.mark.parametrize("query", ["raft consensus", "consensus raft raft consensus log", "nothing here"])
def test_nearest(spark, query, k):
    many = {str(i): ("raft consensus log " * (i % 3 + 1) if i % 4 else f"word{i} search") for i in range(60)}
    p = SemanticParams(32, 6, 3)
    index = SemanticIndex.build(documents(spark, many), p)
    cos = py_cosines(many, query, 32)
    got = [tuple(r) for r in index.query(query, k).collect()]
    assert got == order({i: cos[i] for i in py_candidates(many, query, k, p)}, k)
    assert [tuple(r) for r in index.query(query, k, exact=True).collect()] == order(cos, k)


def test_vector_topk_all(spark, tmp_path):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((901, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1100, [0.0] * 8)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = collections.defaultdict(list)
    for r in catalog.queries()["vector_topk_all"](spark, str(tmp_path)).orderBy("query_id", "r").collect():
        got[r.query_id].append(r.vec_id)
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    assert sorted(got) == [*range(0, 901, 100), 1100]
    for q in range(0, 901, 100):
        score = np.round(y @ y[q], 6)
        assert got[q] == sorted(range(901), key=lambda i: (-score[i], i))[:10]


def test_vector_measures_all(spark, tmp_path):
    spark.createDataFrame([(i, [float(i), 1.0]) for i in (0, 1, 2, 3, 5)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.dot for r in catalog.queries()["vector_measures_all"](spark, str(tmp_path)).collect()}
    assert got == {0: 1.0, 1: 3.0, 2: 7.0}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_recall_of_probes(spark):
    """At least 9 of the 10 nearest by brute force, of 10,000 documents."""
    index = SemanticIndex.build(from_texts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))).vectors.cache()
    index = SemanticIndex(index, SemanticParams())
    best = {r.doc_id for r in index.query(catalog.QUERY, 10, exact=True).collect()}
    assert len(best & {r.doc_id for r in index.query(catalog.QUERY, 10, radius=catalog.RADIUS).collect()}) >= 9


def test_hybrid_and_many(spark):
    docs = documents(spark)
    service = SearchService(LexicalIndex.build(docs), SemanticIndex.build(docs))
    for query in ("consensus raft", "raft raft log", "zebra"):
        lex, near = py_bm25(TEXTS, query), dict(order(py_cosines(TEXTS, query, 128), 10))
        fused = {i: lex.get(i, 0) + 0.65 * near.get(i, 0) for i in {*lex, *near}}
        rows = service.search(query, 4).collect()
        assert [(r.doc_id, r.score) for r in rows] == order(fused, 4)
        assert rows[0].title == "t" + rows[0].doc_id and rows[0].url == "u" + rows[0].doc_id
    qs = spark.createDataFrame([("a", "consensus raft"), ("b", "!!"), ("c", None), ("d", "zebra")], "query_id string, text string")
    got = collections.defaultdict(list)
    for r in service.search_many(qs, 3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    assert set(got) == {"a", "d"}
    assert got["a"] == [(r.doc_id, r.score) for r in service.search("consensus raft", 3, exact=True).collect()]


def test_semantic_side_lifts_documents_without_the_terms(spark):
    texts = {"lex": "keyword match keyword", "sem": "dense retrieval embeddings"}
    docs = documents(spark, texts)
    params = RankParams(lexical_weight=0.2, semantic_weight=1.0)
    service = SearchService(LexicalIndex.build(docs), SemanticIndex.build(docs, SemanticParams(64, 16, 42)), params)
    top = service.search("dense retrieval", 5).collect()
    assert top[0].doc_id == "sem" and len(top) == 2
    lone = SearchService(LexicalIndex.build(docs)).search("keyword search", 5).collect()
    assert [(r.doc_id, r.score) for r in lone] == [("lex", 0.0)]


def test_api(spark):
    docs = documents(spark)
    service = SearchService(LexicalIndex.build(docs), SemanticIndex.build(docs))
    assert query_param("/search?q=a+b&q=c") == "a b" and query_param("/search") == ""
    assert answer(service, "!!!") == "null\n" and answer(None, "x") == "null\n"
    assert json.loads(answer(SearchService(LexicalIndex.build(docs)), "zebra")) == []
    server = make_server(service, ("127.0.0.1", 0), Registry())
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    rows = json.loads(urllib.request.urlopen(f"{base}/search?q=raft").read())
    assert list(rows[0]) == ["doc_id", "score", "title", "snippet", "url"] and rows[0]["doc_id"] == "10"
    text = urllib.request.urlopen(f"{base}/metrics").read().decode()
    assert 'search_requests_total{status="ok"} 1' in text and "search_latency_seconds_count 1" in text
    server.shutdown()


def test_metrics(spark):
    df = spark.createDataFrame([("ok", 0.005), ("ok", 0.3), ("error", 99.0), (None, None)], "s string, v double")
    assert {(r.label, r.n) for r in labelled_counts(df, "s").collect()} == {("ok", 2), ("error", 1), (None, 1)}
    h = {r.le: r.n for r in latency_histogram(df, "v").collect()}
    assert h["0.005"] == 1 and h["0.25"] == 1 and h["0.5"] == 2 and h["10"] == 2 and h["+Inf"] == h["count"] == 3 and round(h["sum"], 3) == 99.305


def test_texts_with_nulls(spark):
    df = spark.createDataFrame([(10, "a"), (2, None)], "doc_id long, text string")
    index = LexicalIndex.build(from_texts(df))
    assert [r.doc_id for r in index.documents().collect()] == ["10", "2"] and index.document_count() == 2
    assert index.docs.where(F.col("doc_id") == "2").first()["doc_len"] == 0
