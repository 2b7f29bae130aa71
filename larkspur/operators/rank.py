"""BM25 ranking, for one query and for many."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RankParams
from .index import LexicalIndex

DIGITS = 6


def query_tokens(query: str) -> list[str]:
    """Tokens of a query: runs of ASCII letters and digits in lower case."""
    return [t.lower() for t in re.findall("[a-zA-Z0-9]+", query or "")]


def idf(n_docs: Column, df: Column) -> Column:
    """Inverse document frequency, never below zero."""
    return F.greatest(F.lit(0.0), F.log((n_docs - df + 0.5) / (df + 0.5)))


def term_weight(tf: Column, doc_len: Column, avgdl: Column, p: RankParams) -> Column:
    """BM25 saturation of a term frequency; an empty document counts as one of average length."""
    avg = F.when(avgdl == 0, F.lit(1.0)).otherwise(avgdl)
    length = F.when(doc_len == 0, avg).otherwise(doc_len)
    return tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * (length / avg)))


def ranked(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Scores rounded, best first, ties by id; k <= 0 keeps all."""
    out = scores.withColumn(score, F.round(score, DIGITS)).orderBy(F.desc(score), "doc_id")
    return out.limit(k) if k > 0 else out


def top_per_query(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best rows of each query with their rank."""
    out = scores.withColumn(score, F.round(score, DIGITS))
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id")
    out = out.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k > 0 else out


def bm25(index: LexicalIndex, query: str, params: RankParams = RankParams()) -> DataFrame:
    """(doc_id, score) of every document holding a query term; repeated terms count again."""
    tokens = query_tokens(query)
    spark = index.docs.sparkSession
    if not tokens:
        return spark.createDataFrame([], "doc_id string, score double")
    hits = index.postings_for(sorted(set(tokens)))
    times = spark.createDataFrame([(t, tokens.count(t)) for t in dict.fromkeys(tokens)], "term string, times int")
    freq = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(times), "term")
    rows = hits.join(F.broadcast(freq), "term").crossJoin(F.broadcast(index.corpus_stats))  # no more rows than query terms; one row
    weight = F.col("times") * idf(F.col("n_docs"), F.col("df")) * term_weight(F.col("tf"), F.col("doc_len"), F.col("avgdl"), params)
    return rows.groupBy("doc_id").agg(F.sum(weight).alias("score"))


def bm25_top(
    index: LexicalIndex, queries: list[tuple[str, str]], k: int, also: dict[str, set[str]] | None = None, params: RankParams = RankParams()
) -> DataFrame:
    """(query_id, doc_id, score): the k best documents of each of a block of queries, and the documents asked for besides.

    queries: (id, text), a block of bounded size; also: doc_id -> ids of queries whose score with it is wanted.
    Documents are scored where they lie: each task holds whole documents, keeps its k best of every query
    and sends no more than those, so queries * tasks * k rows are shuffled whatever the collection's size.
    k <= 0 keeps all.
    """
    spark = index.docs.sparkSession
    shape = "query_id string, doc_id string, score double"
    asked = [(q, t, n) for q, text in queries for t, n in Counter(query_tokens(text)).items()]
    if not asked:
        return spark.createDataFrame([], shape)
    stats = index.corpus_stats.first()
    terms = sorted({t for _, t, _ in asked})
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string"))
    df = {r["term"]: r["df"] for r in index.term_stats.join(wanted, "term").collect()}  # no more rows than terms
    terms = sorted(df)
    place = {t: i for i, t in enumerate(terms)}
    rows = sorted((place[t], q, n) for q, t, n in asked if t in place)
    names = sorted({q for _, q, _ in rows})
    number = {q: i for i, q in enumerate(names)}
    n_docs = stats["n_docs"]
    weight = np.array([n * max(0.0, math.log((n_docs - df[terms[t]] + 0.5) / (df[terms[t]] + 0.5))) for t, _, n in rows])
    first = np.searchsorted([t for t, _, _ in rows], np.arange(len(terms) + 1))
    of = np.array([number[q] for _, q, _ in rows], np.int64)
    extra = sorted((d, number[q]) for d, qs in (also or {}).items() for q in qs if q in number)
    held = spark.sparkContext.broadcast((terms, names, first, of, weight, extra))
    avg, k1, b = stats["avgdl"] or 1.0, params.k1, params.b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, names, first, of, weight, extra = held.value
        known = pa.array(terms, pa.string())
        extra_docs = pa.array([d for d, _ in extra], pa.string())
        best_q, best_s, best_d = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        for batch in batches:
            lists, n = batch.column(1), batch.num_rows
            at = pc.index_in(lists.flatten(), known).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            hit = ~np.isnan(at) if at.dtype.kind == "f" else np.ones(len(at), bool)
            pair, tf = np.unique(row[hit] * len(terms) + at[hit].astype(np.int64), return_counts=True)
            doc, term = pair // len(terms), pair % len(terms)
            size = batch.column(2).to_numpy().astype(np.float64)[doc]
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * (np.where(size == 0, avg, size) / avg)))
            count = first[term + 1] - first[term]
            to = np.repeat(first[term], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            key, where = np.unique(of[to] * n + np.repeat(doc, count), return_inverse=True)
            score = np.round(np.bincount(where, weight[to] * np.repeat(part, count), len(key)), DIGITS + 4)
            names_of = np.array(batch.column(0).to_pylist(), object)
            q, d = key // n, key % n
            if extra:
                place = pc.index_in(batch.column(0), extra_docs).to_numpy(zero_copy_only=False)
                some = np.flatnonzero(~np.isnan(place)) if place.dtype.kind == "f" else np.arange(n)
                at_row = {names_of[i]: i for i in some.tolist()}
                pairs = np.array([x * n + at_row[y] for y, x in extra if y in at_row], np.int64)
                wanted = np.isin(key, pairs)
                yield made(names, q[wanted], names_of[d[wanted]], score[wanted])
                q, d, score = q[~wanted], d[~wanted], score[~wanted]
            q, s, ids = np.concatenate([best_q, q]), np.concatenate([best_s, score]), np.concatenate([best_d, names_of[d]])
            if k > 0:  # a score below the k-th of its query cannot be among the best; ties are settled by id
                shown = np.round(s, DIGITS)
                order = np.lexsort((-shown, q))
                start = np.searchsorted(q[order], np.arange(len(names) + 1))
                edge = np.full(len(names), -np.inf)
                full = np.diff(start) >= k
                edge[full] = shown[order][start[:-1][full] + k - 1]
                near = np.flatnonzero(shown >= edge[q])
                near = near[np.lexsort((ids[near].astype(str), -shown[near], q[near]))]
                rank = np.arange(len(near)) - np.searchsorted(q[near], q[near])
                near = near[rank < k]
                q, s, ids = q[near], s[near], ids[near]
            best_q, best_s, best_d = q, s, ids
        yield made(names, best_q, best_d, best_s)

    def made(names: list[str], q: np.ndarray, d: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([names[i] for i in q.tolist()], pa.string()), pa.array(d.tolist(), pa.string()), pa.array(s.astype(np.float64))], ["query_id", "doc_id", "score"])

    return index.docs.select("doc_id", "tokens", "doc_len").mapInArrow(run, shape)
