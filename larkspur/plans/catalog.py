"""Registry of the engine's queries and their SQL twins."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CrawlParams, SemanticParams
from ..functions import html as H
from ..functions.text import document_id, fnv1a, snippet, tokenize
from ..functions.vector import cosine, dot, magnitude
from ..operators.hybrid import SearchService
from ..operators.index import LexicalIndex, corpus_stats_of, from_texts, latest, postings_of, term_stats_of, with_lengths
from ..operators.metrics import BUCKETS, Registry, labelled_counts, latency_histogram
from ..operators.rank import bm25, query_tokens, ranked
from ..operators.semantic import SemanticIndex, embed_query, embeddings, nearest_many, planes
from ..sources.files import decode_messages, encode_messages, fetching, from_table, load_snapshot, parse_pages, read_files
from ..sources.sinks import snapshot_rows, write_snapshot
from ..storage import checkpoint_dir
from ..streaming.updater import IndexUpdater, current
from .crawl import crawl, next_frontier

PARAMS = SemanticParams()
QUERY = "stale index shard"
REPEATED = "vector vector crawler"
COMMON = "the index unheardofterm"
K = 10
VECTOR_QUERIES = 5
#: `vector_topk_all` asks every row whose id this divides.
VECTOR_STEP = 100
#: Bits of a signature that `ann_topk_probed` lets differ.
RADIUS = 11
#: Pages that `crawl_budget` takes up.
BUDGET = 200


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _work(spark: SparkSession, name: str) -> str:
    """A folder of its own for the files of one run."""
    return f"{checkpoint_dir(spark)}/{name}-{os.urandom(6).hex()}"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return from_texts(_table(spark, d, "documents"))


def _index(spark: SparkSession, d: str) -> LexicalIndex:
    return LexicalIndex.build(_docs(spark, d))


def _service(spark: SparkSession, d: str) -> SearchService:
    docs = _docs(spark, d)
    return SearchService(LexicalIndex.build(docs), SemanticIndex.build(docs, PARAMS))


def tokenize_docs(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", tokenize(F.col("content")).alias("tokens"))


def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return postings_of(with_lengths(_docs(spark, d))).select("doc_id", "term", "tf")


def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return term_stats_of(postings_of(with_lengths(_docs(spark, d))))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus_stats_of(with_lengths(_docs(spark, d))).select("n_docs", "total_tokens", F.round("avgdl", 6).alias("avgdl"))


def supplied_tokens(spark: SparkSession, d: str) -> DataFrame:
    src = latest(_table(spark, d, "snapshot_documents"), "id", "url", "title", "content")
    docs = src.select(F.col("id").alias("doc_id"), "url", "title", "content", "tokens")
    return with_lengths(docs).select("doc_id", "doc_len")


def postings_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).postings_for(["index", "shard"]).select("term", "doc_id", "tf", "doc_len")


def document_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).document("7").select("doc_id", "url", "doc_len")


def latest_documents(spark: SparkSession, d: str) -> DataFrame:
    old = _table(spark, d, "snapshot_documents").select("id", "content", F.lit(0).cast("long").alias("seq"))
    new = _table(spark, d, "snapshot_batches").select("id", "content", "seq")
    return latest(old.unionByName(new).where("id is not null"), "id", "seq", "content").select("id", "seq", "content")


def _bm25(query: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: ranked(bm25(_index(spark, d), query), K)


def fnv_hash_tokens(spark: SparkSession, d: str) -> DataFrame:
    terms = _docs(spark, d).select(F.explode(tokenize(F.col("content"))).alias("term")).distinct()
    return terms.select("term", fnv1a(F.col("term")).alias("hash"))


def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    return embeddings(_docs(spark, d), PARAMS)


def _semantic(spark: SparkSession, d: str) -> SemanticIndex:
    return SemanticIndex.build(_docs(spark, d), PARAMS)


def lsh_signature(spark: SparkSession, d: str) -> DataFrame:
    return _semantic(spark, d).vectors.select("doc_id", "sig")


def lsh_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _semantic(spark, d).buckets()


def cosine_topk_exact(spark: SparkSession, d: str) -> DataFrame:
    return _semantic(spark, d).query(QUERY, K, exact=True)


def ann_topk(spark: SparkSession, d: str) -> DataFrame:
    return _semantic(spark, d).query(QUERY, K)


def ann_topk_probed(spark: SparkSession, d: str) -> DataFrame:
    return _semantic(spark, d).query(QUERY, K, radius=RADIUS)


def vector_measures(spark: SparkSession, d: str) -> DataFrame:
    """Each row of even id with its successor, as its SQL twin has it."""
    return _measures(spark, d).where("vec_id % 2 = 0")


def _measures(spark: SparkSession, d: str) -> DataFrame:
    """Every row with its successor by id."""
    v = _table(spark, d, "embeddings").select("vec_id", "embedding")
    w = _table(spark, d, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    both = v.join(w, "vec_id")
    return both.select(
        "vec_id",
        F.round(dot(F.col("embedding"), F.col("next")), 4).alias("dot"),
        F.round(magnitude(F.col("embedding")), 4).alias("norm"),
        F.round(cosine(F.col("embedding"), F.col("next")), 4).alias("cosine"),
    )


def _nearest(rows: DataFrame, asked: list) -> DataFrame:
    near = nearest_many(rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), asked, K, "bigint")
    best = near.withColumn("r", F.expr("row_number() over (partition by query_id order by score desc, doc_id)")).where(F.col("r") <= K)
    return best.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("r").cast("bigint").alias("r"), F.round("score", 4).alias("score"), F.col("doc_id").alias("vec_id"))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of the first few rows only, as its SQL twin has it."""
    rows = _table(spark, d, "embeddings").where("embedding is not null")
    asked = [(r["vec_id"], r["embedding"]) for r in rows.orderBy("vec_id").limit(VECTOR_QUERIES).collect()]
    return _nearest(rows, asked).drop("vec_id")


def vector_topk_all(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of every row whose id is divisible by 100, over all rows; the queries pass through the driver as arrays."""
    rows = _table(spark, d, "embeddings").where("embedding is not null")
    asked = rows.where(F.col("vec_id") % VECTOR_STEP == 0).select("vec_id", "embedding")
    return _nearest(rows, [(r["vec_id"], np.array(r["embedding"], np.float32)) for r in asked.toLocalIterator()])


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return _service(spark, d).scores(QUERY, K)


def hybrid_exact(spark: SparkSession, d: str) -> DataFrame:
    return _service(spark, d).scores(QUERY, K, exact=True)


def search_results(spark: SparkSession, d: str) -> DataFrame:
    return _service(spark, d).search(QUERY, K)


def snippets(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*(F.lit(t) for t in query_tokens(QUERY)))
    return _docs(spark, d).select("doc_id", snippet(F.col("content"), words).alias("snippet"))


def batch_search(spark: SparkSession, d: str) -> DataFrame:
    queries = _table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")
    docs = _docs(spark, d)
    return SearchService(LexicalIndex.build(docs), SemanticIndex.build(docs, PARAMS)).search_many(queries, K)


def doc_id_sha1(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", document_id(F.col("url")).alias("doc_id"))


def page_title(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", H.title(F.col("html")).alias("title"))


def page_text(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", H.text(F.col("html")).alias("content"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "pages").select("page_id", F.posexplode(H.links(F.col("url"), F.col("html"))).alias("n", "link"))
    return rows.select("page_id", (F.col("n") + 1).cast("bigint").alias("n"), "link")


def page_link_counts(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", F.size(H.hrefs(F.col("html"))).cast("bigint").alias("links"))


def crawl_frontier(spark: SparkSession, d: str) -> DataFrame:
    """One hop from every tenth page: fetch, parse, new links in order, within a budget of 1000 urls."""
    pages = _table(spark, d, "pages").where("url is not null and url <> ''")
    seeds = pages.where("page_id % 10 = 0").select("url").distinct()
    got = from_table(pages)(seeds).where("error is null")
    return next_frontier(parse_pages(got, "url", "body").select(F.explode("links").alias("url")), seeds, 1000)


def crawl_all(spark: SparkSession, d: str) -> DataFrame:
    """Level by level from every page of the table, without a budget: all urls taken up, and whether they were found."""
    pages = _table(spark, d, "pages").where("url is not null and url <> ''")
    got = crawl(pages.select("url"), from_table(pages), CrawlParams(max_pages=None))
    found = got.documents.select("url", "depth", F.lit(True).alias("found"))
    return found.unionByName(got.errors.select("url", "depth", F.lit(False).alias("found")))


def crawl_sites(spark: SparkSession, d: str) -> DataFrame:
    """As `crawl_all`, from the first url of each host only, so that the other pages are reached by links or not at all."""
    pages = _table(spark, d, "pages").where("url is not null and url <> ''")
    got = crawl(_site_seeds(pages), from_table(pages), CrawlParams(max_pages=None))
    found = got.documents.select("url", "depth", F.lit(True).alias("found"))
    return found.unionByName(got.errors.select("url", "depth", F.lit(False).alias("found")))


def _site_seeds(pages: DataFrame) -> DataFrame:
    return pages.groupBy(F.regexp_extract("url", "^[a-z]+://[^/]*", 0)).agg(F.min("url").alias("url")).select("url")


def crawl_budget(spark: SparkSession, d: str) -> DataFrame:
    """As `crawl_sites`, level by level, until the budget of pages is used up."""
    pages = _table(spark, d, "pages").where("url is not null and url <> ''")
    got = crawl(_site_seeds(pages), from_table(pages), CrawlParams(max_pages=BUDGET))
    found = got.documents.select("url", "depth", F.lit(True).alias("found"))
    return found.unionByName(got.errors.select("url", "depth", F.lit(False).alias("found")))


def crawl_counters(spark: SparkSession, d: str) -> DataFrame:
    """What the counters say after a crawl from every page."""
    pages = _table(spark, d, "pages").where("url is not null and url <> ''")
    registry = Registry()
    crawl(pages.select("url"), from_table(pages), CrawlParams(max_pages=None), registry=registry)
    return spark.createDataFrame([("documents", registry.crawled), ("errors", registry.crawl_errors)], "counter string, n long")


def fetched_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of all pages, written as one file each and fetched by their file urls."""
    work = _work(spark, "fetch")
    pages = _table(spark, d, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("value"))
    pages.repartition("page_id").write.partitionBy("page_id").text(f"{work}/pages")
    urls = read_files(spark, f"{work}/pages").select("url")
    got = fetching(workers=int(spark.conf.get("spark.sql.shuffle.partitions")), politeness=0.0)(urls).where("error is null")
    return parse_pages(got, "url", "body").select(F.regexp_extract("url", "page_id=([0-9]+)", 1).cast("bigint").alias("page_id"), "title")


def snapshot_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """All documents written as a snapshot file and loaded from it."""
    path = f"{_work(spark, 'snapshot')}/s.json"
    write_snapshot(_docs(spark, d), path)
    return load_snapshot(spark, path).select("doc_id", "url", "title", "content")


def _streamed(spark: SparkSession, messages: DataFrame, name: str) -> IndexUpdater:
    """An updater that has taken in messages (value, n), n being their order, as a stream."""
    work = _work(spark, name)
    messages.write.parquet(f"{work}/in")
    lines = spark.readStream.schema("value string, n long").parquet(f"{work}/in")
    seq = F.struct(F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("string").alias("file"), F.col("n"))
    updater = IndexUpdater(spark, f"{work}/index")
    updater.start(lines.select("value", seq.alias("seq")), f"{work}/ck", availableNow=True).awaitTermination()
    return updater


def snapshot_and_stream(spark: SparkSession, d: str) -> DataFrame:
    """The latest content of every document of a snapshot and of the stream that follows it."""
    columns = ["url", "title", "content", "tokens"]
    docs = lambda name, *more: _table(spark, d, name).where("id is not null").select(F.col("id").alias("doc_id"), *columns, F.lit(None).cast("string").alias("fetched_at"), *more)
    new = docs("snapshot_batches", "seq")
    sent = encode_messages(new, "seq")
    updater = _streamed(spark, sent.select("value", F.col("seq").alias("n")), "updates")
    return current(spark, updater.folder, docs("snapshot_documents")).select("doc_id", "content")


def stream_poison(spark: SparkSession, d: str) -> DataFrame:
    """Ids indexed from a stream in which documents without a text are broken messages."""
    docs = _docs(spark, d).withColumn("fetched_at", F.lit(None).cast("string"))
    sent = encode_messages(docs, "content").withColumn("value", F.when(F.col("content") == "", F.lit('{"ID": ')).otherwise(F.col("value")))
    updater = _streamed(spark, sent.select("value", F.lit(0).cast("long").alias("n")), "poison")
    return updater.documents().select("doc_id", F.length("content").cast("bigint").alias("size"))


def snapshot_export(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_rows(with_lengths(_docs(spark, d)))


def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).withColumn("fetched_at", F.lit(None).cast("string"))
    back = encode_messages(docs).select(decode_messages(F.col("value")).alias("d")).where("d is not null")
    return back.select("d.doc_id", "d.url", "d.content", "d.fetched_at")


def stream_index(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies after streaming all documents as messages in several micro-batches."""
    work = _work(spark, "stream")
    encode_messages(_docs(spark, d).withColumn("fetched_at", F.lit(None).cast("string"))).repartition(4).write.parquet(f"{work}/in")
    shape = "key string, value string"
    lines = spark.readStream.schema(shape).option("maxFilesPerTrigger", 2).parquet(f"{work}/in")
    seq = F.struct(F.lit(None).cast("timestamp").alias("at"), F.col("key").alias("file"), F.lit(0).cast("long").alias("n"))
    updater = IndexUpdater(spark, f"{work}/index")
    updater.start(lines.select("value", seq.alias("seq")), f"{work}/ck", availableNow=True).awaitTermination()
    return term_stats_of(updater.index().postings)


def request_counts(spark: SparkSession, d: str) -> DataFrame:
    return labelled_counts(_table(spark, d, "events"), "event_type")


def latencies(spark: SparkSession, d: str) -> DataFrame:
    rows = latency_histogram(_table(spark, d, "events"), "value")
    return rows.select("le", F.round("n", 3).alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "tokenize_docs": tokenize_docs,
        "term_frequency": term_frequency,
        "document_frequency": document_frequency,
        "corpus_stats": corpus_stats,
        "supplied_tokens": supplied_tokens,
        "postings_lookup": postings_lookup,
        "document_lookup": document_lookup,
        "latest_documents": latest_documents,
        "bm25_topk": _bm25(QUERY),
        "bm25_duplicate_terms": _bm25(REPEATED),
        "bm25_common_term_zero": _bm25(COMMON),
        "fnv_hash_tokens": fnv_hash_tokens,
        "hash_embedding": hash_embedding,
        "lsh_signature": lsh_signature,
        "lsh_buckets": lsh_buckets,
        "cosine_topk_exact": cosine_topk_exact,
        "ann_topk": ann_topk,
        "ann_topk_probed": ann_topk_probed,
        "vector_measures": vector_measures,
        "vector_measures_all": _measures,
        "vector_topk": vector_topk,
        "vector_topk_all": vector_topk_all,
        "hybrid_topk": hybrid_topk,
        "hybrid_exact": hybrid_exact,
        "search_results": search_results,
        "snippets": snippets,
        "batch_search": batch_search,
        "doc_id_sha1": doc_id_sha1,
        "page_title": page_title,
        "page_text": page_text,
        "page_links": page_links,
        "page_link_counts": page_link_counts,
        "crawl_frontier": crawl_frontier,
        "crawl_all": crawl_all,
        "crawl_sites": crawl_sites,
        "crawl_budget": crawl_budget,
        "crawl_counters": crawl_counters,
        "fetched_titles": fetched_titles,
        "snapshot_roundtrip": snapshot_roundtrip,
        "snapshot_and_stream": snapshot_and_stream,
        "stream_poison": stream_poison,
        "snapshot_export": snapshot_export,
        "json_roundtrip": json_roundtrip,
        "stream_index": stream_index,
        "request_counts": request_counts,
        "latency_histogram": latencies,
    }


# --- SQL twins -----------------------------------------------------------------------------------

_DOCS = """docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'doc://' || CAST(doc_id AS VARCHAR) AS url, '' AS title, coalesce(text, '') AS content
  FROM documents)"""
_TOK = "list_transform(regexp_extract_all({0}, '[a-zA-Z0-9]+'), lambda x: lower(x))"
_LEN = f"{_DOCS}, lens AS (SELECT *, {_TOK.format('content')} AS tokens, CAST(len({_TOK.format('content')}) AS BIGINT) AS doc_len FROM docs)"
_POST = f"""{_LEN}, toks AS (SELECT doc_id, doc_len, unnest(tokens) AS term FROM lens),
post AS (SELECT term, doc_id, doc_len, count(*) AS tf FROM toks GROUP BY ALL),
stats AS (SELECT term, count(*) AS df FROM post GROUP BY term),
corpus AS (SELECT count(*) AS n_docs, CAST(coalesce(sum(doc_len), 0) AS BIGINT) AS total_tokens, coalesce(avg(doc_len), 0) AS avgdl FROM lens)"""
_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, CAST(length(term) AS BIGINT) + 1), lambda i: CAST(ascii(substr(term, CAST(i AS INTEGER), 1)) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"


def _q(tokens: list[str]) -> str:
    return ", ".join(f"('{t}', {tokens.count(t)})" for t in dict.fromkeys(tokens))


_WEIGHT = """greatest(0, ln((n_docs - df + 0.5) / (df + 0.5))) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 *
  ((CASE WHEN doc_len = 0 THEN avgdl ELSE doc_len END) / CASE WHEN avgdl = 0 THEN 1 ELSE avgdl END))))"""


def _lex(query: str) -> str:
    return f"""q(term, times) AS (VALUES {_q(query_tokens(query))}),
lex AS (SELECT doc_id, sum(times * {_WEIGHT}) AS score FROM q JOIN post USING (term) JOIN stats USING (term) CROSS JOIN corpus GROUP BY doc_id)"""


def _bm25_sql(query: str) -> str:
    return f"WITH {_POST}, {_lex(query)} SELECT doc_id, round(score, 6) AS score FROM lex ORDER BY score DESC, doc_id LIMIT {K}"


_SPARSE = f"""{_POST}, terms AS (SELECT DISTINCT term FROM post),
hashed AS (SELECT term, {_FNV} AS hash FROM terms),
sparse AS (SELECT doc_id, CAST(hash % {PARAMS.dimension} AS INTEGER) AS dim, CAST(sum(tf) AS BIGINT) AS w FROM post JOIN hashed USING (term) GROUP BY ALL),
norms AS (SELECT docs.doc_id, sqrt(CAST(coalesce(sum(w * w), 0) AS DOUBLE)) AS norm FROM docs LEFT JOIN sparse USING (doc_id) GROUP BY ALL)"""


def _planes_sql() -> str:
    rows = ", ".join(f"({p}, {i}, {w})" for p, row in enumerate(planes(PARAMS)) for i, w in enumerate(row))
    return f"planes(plane, dim, w) AS (VALUES {rows})"


def _sig_sql() -> str:
    return f"""{_SPARSE}, {_planes_sql()},
prod AS (SELECT doc_id, plane, sum(CAST(sparse.w AS BIGINT) * planes.w) AS s FROM sparse JOIN planes USING (dim) GROUP BY ALL),
bits AS (SELECT docs.doc_id, p.plane, CASE WHEN coalesce(s, 0) >= 0 THEN '1' ELSE '0' END AS bit
  FROM docs CROSS JOIN (SELECT DISTINCT plane FROM planes) p LEFT JOIN prod ON prod.doc_id = docs.doc_id AND prod.plane = p.plane),
sigs AS (SELECT doc_id, string_agg(bit, '' ORDER BY plane) AS sig FROM bits GROUP BY doc_id)"""


def _qvec_sql(query: str) -> str:
    v = embed_query(query, PARAMS.dimension)
    rows = ", ".join(f"({i}, {w})" for i, w in enumerate(v) if w)
    length = sum(w * w for w in v) ** 0.5
    return f"""qvec(dim, qw) AS (VALUES {rows}),
cos AS (SELECT norms.doc_id, CASE WHEN norm * {length!r} = 0 THEN 0 ELSE coalesce(p.s, 0) / (norm * {length!r}) END AS score
  FROM norms LEFT JOIN (SELECT doc_id, CAST(sum(w * qw) AS BIGINT) AS s FROM sparse JOIN qvec USING (dim) GROUP BY doc_id) p USING (doc_id))"""


def _signature(query: str) -> str:
    v = embed_query(query, PARAMS.dimension)
    return "".join("1" if sum(a * b for a, b in zip(v, p)) >= 0 else "0" for p in planes(PARAMS))


def _ann_sql(query: str) -> str:
    v = embed_query(query, PARAMS.dimension)
    sig = "".join("1" if sum(a * b for a, b in zip(v, p)) >= 0 else "0" for p in planes(PARAMS))
    return f"""{_sig_sql()}, {_qvec_sql(query)},
bucket AS (SELECT doc_id FROM sigs WHERE sig = '{sig}'),
nb AS (SELECT count(*) AS b FROM bucket),
fill AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM sigs), nb WHERE b < {K} AND r <= {5 * K} - b),
cand AS (SELECT doc_id FROM bucket UNION SELECT doc_id FROM fill),
near AS (SELECT doc_id, round(score, 6) AS score FROM cand JOIN cos USING (doc_id) ORDER BY score DESC, doc_id LIMIT {K})"""


_EXACT = f"""{_SPARSE}, {_qvec_sql(QUERY)},
near AS (SELECT doc_id, round(score, 6) AS score FROM cos ORDER BY score DESC, doc_id LIMIT {K})"""
_FUSED = f"""fused AS (SELECT doc_id, sum(score) AS score FROM (
  SELECT doc_id, score FROM lex UNION ALL SELECT doc_id, 0.65 * score FROM near) GROUP BY doc_id),
top AS (SELECT doc_id, round(score, 6) AS score FROM fused ORDER BY score DESC, doc_id LIMIT {K})"""


def _snippet_sql(query: str) -> str:
    first = "coalesce(" + ", ".join(f"nullif(instr(lower(content), '{t}'), 0)" for t in query_tokens(query)) + ")"
    return f"""CASE WHEN content = '' THEN '' WHEN {first} IS NULL THEN substr(content, 1, 80)
  ELSE substr(content, greatest({first} - 40, 1), least({first} + 40, length(content) + 1) - greatest({first} - 40, 1)) END"""


_BATCH = f"""{_SPARSE},
qs AS (SELECT CAST(item_id AS VARCHAR) AS query_id, unnest({_TOK.format("coalesce(text, '')")}) AS term FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS times FROM qs GROUP BY ALL),
lex AS (SELECT query_id, doc_id, sum(times * {_WEIGHT}) AS score FROM qt JOIN post USING (term) JOIN stats USING (term) CROSS JOIN corpus GROUP BY ALL),
qterms AS (SELECT DISTINCT term FROM qt),
qhash AS (SELECT term, {_FNV} AS hash FROM qterms),
qvec AS (SELECT query_id, CAST(hash % {PARAMS.dimension} AS INTEGER) AS dim, CAST(sum(times) AS BIGINT) AS qw FROM qt JOIN qhash USING (term) GROUP BY ALL),
qnorm AS (SELECT query_id, sqrt(CAST(sum(qw * qw) AS DOUBLE)) AS qn FROM qvec GROUP BY query_id),
prod AS (SELECT query_id, doc_id, CAST(sum(w * qw) AS DOUBLE) AS s FROM qvec JOIN sparse USING (dim) GROUP BY ALL),
cos AS (SELECT query_id, doc_id, round(CASE WHEN norm * qn = 0 THEN 0 ELSE coalesce(s, 0) / (norm * qn) END, 6) AS score
  FROM qnorm CROSS JOIN norms LEFT JOIN prod USING (query_id, doc_id)),
near AS (SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM cos) WHERE r <= 10),
fused AS (SELECT query_id, doc_id, round(sum(score), 6) AS score FROM (
  SELECT query_id, doc_id, score FROM lex UNION ALL SELECT query_id, doc_id, 0.65 * score FROM near) GROUP BY ALL),
top AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM fused)"""

_HIST = ", ".join(f"('{b:g}', {b})" for b in BUCKETS)

_PIECES = r"<!--.*?(?:-->|$)|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<title\b[^>]*>.*?</title\s*>|</?[a-zA-Z!?/][^>]*>|[^<]+|<"
_BLANK = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


#: The references that the SQL twins decode, `&amp;` last.
_SQL_ENTITIES = [("&nbsp;?", "\u00a0"), ("&copy;?", "©"), ("&middot;?", "·"), ("&quot;?", '"'), ("&lt;?", "<"), ("&gt;?", ">"), ("&amp;?", "&")]


def _unescape_sql(x: str) -> str:
    out = x
    for pattern, to in _SQL_ENTITIES:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return out


def _trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


_SHOWN = r"regexp_replace(coalesce(html, ''), '<!--.*?(?:-->|$)|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'gis')"
_TITLE = f"""coalesce(list_filter(list_transform(regexp_extract_all({_SHOWN}, '<title\\b[^>]*>(.*?)(?:</title\\s*>|$)', 1, 'is'),
  lambda x: {_trim_sql(_unescape_sql('x'))}), lambda x: x <> '')[1], '')"""
_RAW = r"^<(?:script|style|title)\b[^>]*>(.*)</(?:script|style|title)\s*>$"
_TEXT = f"""list_filter(list_transform(regexp_extract_all(coalesce(html, ''), '{_PIECES}', 0, 'is'), lambda p: {_trim_sql(
    f"CASE WHEN regexp_matches(p, '^<(?:script|style)', 'i') AND regexp_matches(p, '{_RAW}', 'is') THEN regexp_extract(p, '{_RAW}', 1, 'is') "
    f"WHEN regexp_matches(p, '{_RAW}', 'is') THEN {_unescape_sql(f"regexp_extract(p, '{_RAW}', 1, 'is')")} "
    f"WHEN regexp_matches(p, '^</?[a-zA-Z!?/]') THEN '' ELSE {_unescape_sql('p')} END"
)}), lambda p: p <> '')"""
_HREF = r"""<a\s(?:[^>"'']|"[^"]*"|''[^'']*'')*?href\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)"""
_HREFS = f"""list_transform(regexp_extract_all({_SHOWN}, '{_HREF}', 1, 'is'), lambda x: {_unescape_sql("regexp_replace(x, '^[\"'']|[\"'']$', '', 'g')")})"""
_RESOLVED = """CASE WHEN href LIKE 'http://%' OR href LIKE 'https://%' OR href LIKE 'file://%' THEN href WHEN url = '' THEN href
  WHEN url LIKE 'file://%' THEN regexp_replace(url, '[^/]*$', '') || href
  ELSE regexp_replace(url, '/+$', '') || '/' || regexp_replace(href, '^/+', '') END"""
_LINKS = f"""raw AS (SELECT page_id, url, {_HREFS} AS hs FROM pages),
rows AS (SELECT page_id, url, unnest(hs) AS href, unnest(range(1, len(hs) + 1)) AS n FROM raw),
links AS (SELECT page_id, url, n, {_RESOLVED} AS link FROM rows)"""


def _crawl_sql(seeds: str) -> str:
    return f"""WITH RECURSIVE bodies AS (SELECT url, max(coalesce(html, '')) AS html FROM pages WHERE url <> '' GROUP BY url),
raw AS (SELECT url, {_HREFS} AS hs FROM bodies),
rows AS (SELECT url, unnest(hs) AS href FROM raw),
links AS (SELECT DISTINCT url, {_RESOLVED} AS link FROM rows),
seeds AS ({seeds}),
edges AS (SELECT url, link FROM links WHERE link <> ''),
reach(url, depth) AS (SELECT url, 0 FROM seeds UNION
  SELECT link, depth + 1 FROM reach JOIN edges USING (url) WHERE depth < (SELECT count(*) FROM bodies))
SELECT url, min(depth) AS depth, url IN (SELECT url FROM bodies) AS found FROM reach GROUP BY url"""


_SITE_SEEDS = "SELECT min(url) AS url FROM bodies GROUP BY regexp_extract(url, '^[a-z]+://[^/]*', 0)"


def oracle_sql() -> dict[str, str]:
    return {
        "tokenize_docs": f"WITH {_LEN} SELECT doc_id, tokens FROM lens",
        "term_frequency": f"WITH {_POST} SELECT doc_id, term, tf FROM post",
        "document_frequency": f"WITH {_POST} SELECT term, df FROM stats",
        "corpus_stats": f"WITH {_POST} SELECT n_docs, total_tokens, round(avgdl, 6) AS avgdl FROM corpus",
        "supplied_tokens": f"""SELECT id AS doc_id, CAST(CASE WHEN len(t) > 0 THEN len(t) ELSE len({_TOK.format("coalesce(c, '')")}) END AS BIGINT) AS doc_len
FROM (SELECT id, any_value(tokens) AS t, any_value(content) AS c FROM snapshot_documents GROUP BY id)""",
        "postings_lookup": f"WITH {_POST} SELECT term, doc_id, tf, doc_len FROM post WHERE term IN ('index', 'shard')",
        "document_lookup": f"WITH {_LEN} SELECT doc_id, url, doc_len FROM lens WHERE doc_id = '7'",
        "latest_documents": """WITH a AS (SELECT id, content, CAST(0 AS BIGINT) AS seq FROM snapshot_documents UNION ALL SELECT id, content, seq FROM snapshot_batches)
SELECT id, seq, content FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, content DESC NULLS LAST) AS r FROM a WHERE id IS NOT NULL) WHERE r = 1""",
        "bm25_topk": _bm25_sql(QUERY),
        "bm25_duplicate_terms": _bm25_sql(REPEATED),
        "bm25_common_term_zero": _bm25_sql(COMMON),
        "fnv_hash_tokens": f"WITH {_POST} SELECT term, {_FNV} AS hash FROM (SELECT DISTINCT term FROM post)",
        "hash_embedding": f"""WITH {_SPARSE} SELECT docs.doc_id AS doc_id,
  list_transform(range(0, {PARAMS.dimension}), lambda i: coalesce(m[CAST(i AS INTEGER)], 0)) AS vec
FROM docs LEFT JOIN (SELECT doc_id, map(list(dim), list(w)) AS m FROM sparse GROUP BY doc_id) USING (doc_id)""",
        "lsh_signature": f"WITH {_sig_sql()} SELECT doc_id, sig FROM sigs",
        "lsh_buckets": f"WITH {_sig_sql()} SELECT sig, count(*) AS docs FROM sigs GROUP BY sig",
        "cosine_topk_exact": f"WITH {_EXACT} SELECT doc_id, score FROM near",
        "ann_topk": f"WITH {_ann_sql(QUERY)} SELECT doc_id, score FROM near",
        "ann_topk_probed": f"""WITH {_sig_sql()}, {_qvec_sql(QUERY)}
SELECT doc_id, round(score, 6) AS score FROM sigs JOIN cos USING (doc_id) WHERE hamming(sig, '{_signature(QUERY)}') <= {RADIUS} ORDER BY score DESC, doc_id LIMIT {K}""",
        "vector_measures": """WITH v AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)) AS x, list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)) AS y
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)
SELECT vec_id, round(list_dot_product(x, y), 4) AS dot, round(sqrt(list_dot_product(x, x)), 4) AS norm,
  round(CASE WHEN list_dot_product(x, x) * list_dot_product(y, y) = 0 THEN 0 ELSE list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) END, 4) AS cosine FROM v""",
        "vector_measures_all": """WITH v AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)) AS x, list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)) AS y
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_dot_product(x, y), 4) AS dot, round(sqrt(list_dot_product(x, x)), 4) AS norm,
  round(CASE WHEN list_dot_product(x, x) * list_dot_product(y, y) = 0 THEN 0 ELSE list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) END, 4) AS cosine FROM v""",
        "vector_topk": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL),
q AS (SELECT * FROM v ORDER BY vec_id LIMIT {VECTOR_QUERIES}),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.x, v.x) / (sqrt(list_dot_product(q.x, q.x)) * sqrt(list_dot_product(v.x, v.x))), 6) AS score FROM q CROSS JOIN v)
SELECT query_id, r, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= {K}""",
        "vector_topk_all": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL),
n AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS norm FROM v),
s AS (SELECT q.vec_id AS query_id, n.vec_id, round(CASE WHEN q.norm * n.norm = 0 THEN 0 ELSE list_dot_product(q.x, n.x) / (q.norm * n.norm) END, 6) AS score
  FROM n q CROSS JOIN n WHERE q.vec_id % {VECTOR_STEP} = 0)
SELECT query_id, r, round(score, 4) AS score, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= {K}""",
        "hybrid_topk": f"WITH {_ann_sql(QUERY)}, {_lex(QUERY)}, {_FUSED} SELECT doc_id, score FROM top",
        "hybrid_exact": f"WITH {_EXACT}, {_lex(QUERY)}, {_FUSED} SELECT doc_id, score FROM top",
        "search_results": f"""WITH {_ann_sql(QUERY)}, {_lex(QUERY)}, {_FUSED}
SELECT doc_id, score, title, {_snippet_sql(QUERY)} AS snippet, url FROM top JOIN docs USING (doc_id)""",
        "snippets": f"WITH {_DOCS} SELECT doc_id, {_snippet_sql(QUERY)} AS snippet FROM docs",
        "batch_search": f"WITH {_BATCH} SELECT query_id, rank, doc_id, score FROM top WHERE rank <= {K}",
        "doc_id_sha1": "SELECT page_id, sha1(url) AS doc_id FROM pages",
        "page_title": f"SELECT page_id, {_TITLE} AS title FROM pages",
        "page_text": f"SELECT page_id, CASE WHEN len({_TEXT}) > 0 THEN array_to_string({_TEXT}, ' ') || ' ' ELSE '' END AS content FROM pages",
        "page_links": f"WITH {_LINKS} SELECT page_id, n, link FROM links",
        "page_link_counts": f"SELECT page_id, CAST(len({_HREFS}) AS BIGINT) AS links FROM pages",
        "crawl_frontier": f"""WITH seeds AS (SELECT DISTINCT url FROM pages WHERE page_id % 10 = 0 AND url <> ''),
bodies AS (SELECT url, max(coalesce(html, '')) AS html FROM pages WHERE url <> '' GROUP BY url),
raw AS (SELECT url, {_HREFS} AS hs FROM seeds JOIN bodies USING (url)),
rows AS (SELECT url, unnest(hs) AS href FROM raw),
links AS (SELECT DISTINCT {_RESOLVED} AS link FROM rows)
SELECT link AS url FROM links WHERE link <> '' AND link NOT IN (SELECT url FROM seeds) ORDER BY link LIMIT 1000""",
        "crawl_all": _crawl_sql("SELECT url FROM bodies"),
        "crawl_sites": _crawl_sql(_SITE_SEEDS),
        "crawl_budget": _crawl_sql(_SITE_SEEDS) + f" ORDER BY depth, url LIMIT {BUDGET}",
        "crawl_counters": f"""SELECT CASE WHEN found THEN 'documents' ELSE 'errors' END AS counter, count(*) AS n
FROM ({_crawl_sql("SELECT url FROM bodies")}) GROUP BY found""",
        "fetched_titles": f"SELECT page_id, {_TITLE} AS title FROM pages",
        "snapshot_roundtrip": f"WITH {_DOCS} SELECT doc_id, url, title, content FROM docs",
        "snapshot_and_stream": """WITH a AS (SELECT id, content, CAST(-1 AS BIGINT) AS seq FROM snapshot_documents
  UNION ALL SELECT id, coalesce(content, ''), seq FROM snapshot_batches)
SELECT id AS doc_id, content FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM a WHERE id IS NOT NULL) WHERE r = 1""",
        "stream_poison": f"WITH {_DOCS} SELECT doc_id, CAST(length(content) AS BIGINT) AS size FROM docs WHERE content <> ''",
        "snapshot_export": f"WITH {_LEN} SELECT doc_id AS id, url, title, tokens, content FROM lens",
        "json_roundtrip": f"WITH {_DOCS} SELECT doc_id, url, content, '0001-01-01T00:00:00Z' AS fetched_at FROM docs",
        "stream_index": f"WITH {_POST} SELECT term, df FROM stats",
        "request_counts": "SELECT event_type AS label, count(*) AS n FROM events GROUP BY event_type",
        "latency_histogram": f"""WITH b(le, bound) AS (VALUES {_HIST})
SELECT le, CAST(count(*) FILTER (WHERE value <= bound) AS DOUBLE) AS n FROM b CROSS JOIN events WHERE value IS NOT NULL GROUP BY le
UNION ALL SELECT '+Inf', CAST(count(value) AS DOUBLE) FROM events
UNION ALL SELECT 'count', CAST(count(value) AS DOUBLE) FROM events
UNION ALL SELECT 'sum', round(coalesce(sum(value), 0), 3) FROM events""",
    }


