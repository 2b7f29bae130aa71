"""Hashed bag-of-words embeddings, random-hyperplane signatures and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SemanticParams
from ..functions.text import FNV_OFFSET, FNV_PRIME, UINT32, tokenize
from .rank import DIGITS, query_tokens, ranked

#: Queries of one block of a batch search.
QUERY_BLOCK = 2048
#: Vectors of the smallest ids that a stored index keeps apart, for filling up candidates.
FILL = 1000


def planes(params: SemanticParams) -> list[list[int]]:
    """Seeded normal hyperplanes with integer coordinates, so that signs are exact in every engine."""
    rng = np.random.default_rng(params.seed)
    return np.rint(rng.standard_normal((params.planes, params.dimension)) * 1e6).astype(np.int64).tolist()


def hash_token(token: str) -> int:
    """FNV-1a, 32 bits."""
    h = FNV_OFFSET
    for b in token.encode():
        h = ((h ^ b) * FNV_PRIME) & UINT32
    return h


def embed_query(query: str, dimension: int) -> list[int]:
    """Hashed counts of a query's tokens."""
    v = [0] * dimension
    for t in query_tokens(query):
        v[hash_token(t) % dimension] += 1
    return v


def _hash_column(tokens: pa.Array) -> np.ndarray:
    """FNV-1a, 32 bits, of every string of a column: one step a byte position over all strings at once."""
    tokens = tokens.cast(pa.large_string())
    off = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset : tokens.offset + len(tokens) + 1]
    raw = np.frombuffer(tokens.buffers()[2] or b"", np.uint8)
    h = np.full(len(tokens), FNV_OFFSET, np.uint64)
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")  # strings that are still running stay in front
    start, left = off[:-1][order], size[order]
    for i in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -i, "left"))
        at = order[:n]
        h[at] = ((h[at] ^ raw[start[:n] + i]) * np.uint64(FNV_PRIME)) & np.uint64(UINT32)
    return h


def embeddings(docs: DataFrame, params: SemanticParams = SemanticParams(), text: str = "content") -> DataFrame:
    """(doc_id, vec ARRAY<BIGINT>) of every document; the content's own tokens, supplied ones are ignored.

    A document's vector needs only its own row, so nothing is shuffled; documents without tokens have
    a zero vector.
    """
    dimension = params.dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                lists = batch.column(1)
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                dim = (_hash_column(lists.flatten()) % np.uint64(dimension)).astype(np.int64)
                vec = np.bincount(row * dimension + dim, minlength=len(lists) * dimension)
                to = pa.array(np.arange(len(lists) + 1, dtype=np.int32) * dimension)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(to, pa.array(vec))], ["doc_id", "vec"])

    return docs.select("doc_id", tokenize(F.col(text)).alias("t")).mapInArrow(run, "doc_id string, vec array<bigint>")


def with_signatures(vectors: DataFrame, params: SemanticParams) -> DataFrame:
    """(doc_id, vec, norm, sig): sig has one character a hyperplane, 1 where the product is not negative.

    Products are exact integers; the planes travel with the task, their size is fixed.
    """
    rows = np.array(planes(params), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, rows.shape[1])
            length = np.sqrt((v * v).sum(axis=1).astype(np.float64))
            digits = np.where(v @ rows.T >= 0, np.uint8(49), np.uint8(48)).astype(np.uint8)
            to = np.arange(n + 1, dtype=np.int32) * rows.shape[0]
            sig = pa.StringArray.from_buffers(n, pa.py_buffer(to.tobytes()), pa.py_buffer(digits.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(length), sig], ["doc_id", "vec", "norm", "sig"])

    return vectors.select("doc_id", "vec").mapInArrow(run, "doc_id string, vec array<bigint>, norm double, sig string")


@dataclass
class SemanticIndex:
    """Vectors (doc_id, vec, norm, sig) and the parameters they were made with."""

    vectors: DataFrame
    params: SemanticParams
    first: DataFrame | None = None  # the vectors of the `FILL` smallest ids, of a stored index

    @classmethod
    def build(cls, docs: DataFrame, params: SemanticParams = SemanticParams()) -> SemanticIndex:
        return cls(with_signatures(embeddings(docs, params), params), params)

    def save(self, folder: str) -> SemanticIndex:
        """Write the vectors sorted by signature, so that a bucket look-up prunes row groups, and those of the smallest ids."""
        spark = self.vectors.sparkSession
        self.vectors.repartitionByRange("sig").sortWithinPartitions("sig").write.mode("overwrite").parquet(f"{folder}/vectors")
        spark.read.parquet(f"{folder}/vectors").orderBy("doc_id").limit(FILL).coalesce(1).write.mode("overwrite").parquet(f"{folder}/first")
        return self.load(spark, folder, self.params)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, params: SemanticParams = SemanticParams()) -> SemanticIndex:
        return cls(spark.read.parquet(f"{folder}/vectors"), params, spark.read.parquet(f"{folder}/first"))

    def reset(self) -> SemanticIndex:
        """An index of the same parameters without vectors."""
        return SemanticIndex(self.vectors.limit(0), self.params)

    def vector(self, doc_id: str) -> DataFrame:
        return self.vectors.where(F.col("doc_id") == doc_id)

    def buckets(self) -> DataFrame:
        """(sig, docs): how many documents share each signature."""
        return self.vectors.groupBy("sig").agg(F.count(F.lit(1)).alias("docs"))

    def query_signature(self, query: str) -> str:
        v = embed_query(query, self.params.dimension)
        return "".join("1" if sum(a * b for a, b in zip(v, p)) >= 0 else "0" for p in planes(self.params))

    def candidates(self, query: str, k: int) -> DataFrame:
        """Vectors with the query's signature; with fewer than k of them, filled up by id to 5k in all."""
        bucket = self.vectors.where(F.col("sig") == self.query_signature(query))
        if k <= 0:
            return bucket
        source = self.first if self.first is not None and 5 * k <= FILL else self.vectors
        fill = source.orderBy("doc_id").limit(5 * k).withColumn("r", F.row_number().over(Window.orderBy("doc_id")))  # of 5k rows
        held = bucket.agg(F.count(F.lit(1)).alias("b"))  # one row
        fill = fill.crossJoin(F.broadcast(held)).where((F.col("b") < k) & (F.col("r") <= 5 * k - F.col("b")))
        fill = fill.where(F.col("sig") != self.query_signature(query))  # those of the bucket are there already
        return bucket.unionByName(fill.drop("r", "b"))

    def probed(self, query: str, radius: int) -> DataFrame:
        """Vectors of all buckets whose signature differs from the query's in at most `radius` bits."""
        bits = F.conv("sig", 2, 10).cast("bigint").bitwiseXOR(F.lit(int(self.query_signature(query), 2)).cast("bigint"))
        return self.vectors.where(F.bit_count(bits) <= radius)

    def query(self, query: str, k: int = 10, exact: bool = False, radius: int | None = None) -> DataFrame:
        """(doc_id, score) by cosine, best first; exact scores all documents, a radius the buckets within it. k <= 0 keeps all."""
        rows = self.vectors if exact else self.candidates(query, k) if radius is None else self.probed(query, radius)
        return ranked(rows.select("doc_id", cosine_to(F.col("vec"), F.col("norm"), embed_query(query, self.params.dimension)).alias("score")), k)


def cosine_to(vec: Column, norm_: Column, query: list[int]) -> Column:
    """Cosine with a literal query vector; only its non-zero dimensions are read."""
    product = F.lit(0).cast("bigint")
    for i, w in enumerate(query):
        if w:
            product = product + F.get(vec, F.lit(i)) * w
    length = float(np.sqrt(np.dot(query, query))) if query else 0.0
    both = norm_ * F.lit(length)
    return F.when(both == 0, F.lit(0.0)).otherwise(product / both)


def nearest_many(vectors: DataFrame, queries: list[tuple[object, list[float]]], k: int, id_type: str = "string") -> DataFrame:
    """(query_id STRING, doc_id, score): the k nearest by cosine of each query, over all vectors.

    Blocks of vectors meet blocks of at most `QUERY_BLOCK` queries as matrix products; each task
    keeps its k best of every query, so only k rows a task and query are shuffled.
    """
    spark = vectors.sparkSession
    out = None
    for lo in range(0, len(queries), QUERY_BLOCK):
        block = queries[lo : lo + QUERY_BLOCK]
        names = [str(q) for q, _ in block]
        matrix = np.array([v for _, v in block], np.float64)
        held = spark.sparkContext.broadcast((names, matrix, np.sqrt((matrix * matrix).sum(axis=1))))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, q, q_norm = held.value
            ids: list[np.ndarray] = [np.zeros(0, object)] * len(names)
            best: list[np.ndarray] = [np.zeros(0)] * len(names)
            for batch in batches:
                lists = batch.column(1)
                n = len(lists)
                if not n:
                    continue
                v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
                both = np.sqrt((v * v).sum(axis=1))[:, None] * q_norm[None, :]
                score = np.round(np.divide(v @ q.T, both, out=np.zeros_like(both), where=both != 0), DIGITS)
                own = np.array(batch.column(0).to_pylist(), object)
                for j in range(len(names)):
                    s, i = np.concatenate([best[j], score[:, j]]), np.concatenate([ids[j], own])
                    if k > 0 and len(s) > k:
                        edge = np.partition(s, len(s) - k)[len(s) - k]
                        near = np.flatnonzero(s >= edge)
                        near = near[np.lexsort((i[near].astype(str) if isinstance(i[0], str) else i[near].astype(np.int64), -s[near]))][:k]
                        s, i = s[near], i[near]
                    best[j], ids[j] = s, i
            kind = pa.string() if id_type == "string" else pa.int64()
            for j, name in enumerate(names):
                if len(best[j]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(best[j])), pa.array(ids[j].tolist(), kind), pa.array(best[j])], ["query_id", "doc_id", "score"]
                    )

        part = vectors.select("doc_id", "vec").mapInArrow(run, f"query_id string, doc_id {id_type}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"query_id string, doc_id {id_type}, score double")
    return out
