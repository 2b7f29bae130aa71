"""Hybrid retrieval: weighted union of lexical and semantic scores, with snippets."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field
from itertools import batched

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RankParams
from ..functions.text import snippet, tokenize
from ..schema import SEARCH_RESULT
from .index import LexicalIndex
from .rank import DIGITS, bm25, bm25_top, query_tokens, ranked, top_per_query
from .semantic import QUERY_BLOCK, SemanticIndex, embed_query, nearest_many


def fuse(lexical: DataFrame, semantic: DataFrame, params: RankParams, *keys: str) -> DataFrame:
    """Weighted sum over the union of both sides; a missing side counts 0."""
    one = lexical.select(*keys, (F.col("score") * params.lexical_weight).alias("score"))
    two = semantic.select(*keys, (F.col("score") * params.semantic_weight).alias("score"))
    return one.unionByName(two).groupBy(*keys).agg(F.sum("score").alias("score"))


@dataclass
class SearchService:
    """Queries over an index; without a semantic index the ranking is lexical only."""

    index: LexicalIndex
    semantic: SemanticIndex | None = None
    params: RankParams = field(default_factory=RankParams)

    def scores(self, query: str, k: int = 10, exact: bool = False) -> DataFrame:
        """(doc_id, score), best first: ranked before any content is read."""
        lexical = bm25(self.index, query, self.params)
        if self.semantic is None:
            return ranked(lexical, k)
        near = self.semantic.query(query, max(k, self.params.semantic_floor), exact)
        # semantic hits must be stored documents; lexical ones are by construction
        near = self.index.docs.select("doc_id").join(F.broadcast(near) if k > 0 else near, "doc_id")
        return ranked(fuse(lexical, near, self.params, "doc_id"), k)

    def search(self, query: str, k: int = 10, exact: bool = False) -> DataFrame:
        """(doc_id, score, title, snippet, url) of the k best documents; no rows for a query without tokens."""
        tokens = query_tokens(query)
        spark = self.index.docs.sparkSession
        if not tokens:
            return spark.createDataFrame([], SEARCH_RESULT)
        top = self.scores(query, k, exact)
        if k > 0:
            top = F.broadcast(top)  # k rows
        words = F.array(*(F.lit(t) for t in tokens))
        rows = self.index.docs.join(top, "doc_id")
        out = rows.select("doc_id", "score", "title", snippet(F.col("content"), words).alias("snippet"), "url")
        return out.orderBy(F.desc("score"), "doc_id")

    def search_many(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, rank, doc_id, score) of the k best documents of each query of (query_id STRING, text).

        The semantic side is exact.  Queries pass through the driver in blocks of `QUERY_BLOCK`; a block
        needs two passes over the collection, of which each task sends its best rows only.
        """
        rows = ((r["query_id"], r["text"]) for r in queries.select("query_id", "text").toLocalIterator())
        found = [self._search_block(list(block), k) for block in batched(((q, t) for q, t in rows if query_tokens(t)), QUERY_BLOCK)]
        if not found:
            return self.index.docs.sparkSession.createDataFrame([], "query_id string, rank int, doc_id string, score double")
        return functools.reduce(DataFrame.unionByName, found)

    def _search_block(self, block: list[tuple[str, str]], k: int) -> DataFrame:
        if self.semantic is None:
            return top_per_query(bm25_top(self.index, block, k, None, self.params), k).select("query_id", "rank", "doc_id", "score")
        dim = self.semantic.params.dimension
        floor = max(k, self.params.semantic_floor)
        near = nearest_many(self.semantic.vectors, [(q, embed_query(t, dim)) for q, t in block], floor)
        best = [tuple(r) for r in top_per_query(near, floor).select("query_id", "doc_id", "score").collect()]  # floor rows a query
        also: dict[str, set[str]] = {}
        for q, d, _ in best:
            also.setdefault(d, set()).add(q)
        lexical = bm25_top(self.index, block, k, also, self.params)
        near = self.index.docs.sparkSession.createDataFrame(best, "query_id string, doc_id string, score double")
        fused = fuse(lexical, near, self.params, "query_id", "doc_id")
        return top_per_query(fused, k).select("query_id", "rank", "doc_id", "score")


__all__ = ["DIGITS", "SearchService", "fuse", "tokenize"]
