"""Lexical index tables: documents, postings, term statistics and corpus statistics.

Layout when stored: `docs` (latest version of each id), `postings` in folders by a hash of the term
and sorted by term within a file, `term_stats`, `corpus_stats`, `layout`.  Point look-ups prune folders by the
hash and row groups by the term.  The number of folders follows the number of tokens; a term held by more
than `HOT_DOCS` documents is cut into as many parts as it has multiples of them, so no task writes all of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize, tokens_or

#: Tokens for a folder of postings, and bounds of the folders; documents of a term for a part of it.
BUCKET_TOKENS, LEAST_BUCKETS, MOST_BUCKETS = 50_000_000, 16, 4096
HOT_DOCS = 1_000_000


def from_texts(df: DataFrame, key: str = "doc_id", text: str = "text", scheme: str = "doc://") -> DataFrame:
    """Documents of a plain table of texts: string ids, no title, a url made of the id; null text is empty."""
    i = F.col(key).cast("string")
    return df.select(
        i.alias("doc_id"),
        F.concat(F.lit(scheme), i).alias("url"),
        F.lit("").alias("title"),
        F.coalesce(F.col(text), F.lit("")).alias("content"),
        F.lit(None).cast("array<string>").alias("tokens"),
    )


def latest(df: DataFrame, key: str, *version: str) -> DataFrame:
    """The last version of each key by the version columns; partial aggregation, no sort of groups."""
    order = F.struct(*version)
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(key, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*df.columns)


def with_lengths(docs: DataFrame) -> DataFrame:
    """Documents with their effective tokens and `doc_len`."""
    return docs.withColumn("tokens", tokens_or(F.col("tokens"), F.coalesce("content", F.lit("")))).withColumn(
        "doc_len", F.size("tokens").cast("long")
    )


def postings_of(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, doc_len) of documents with lengths; counted within each input block before the shuffle."""
    terms = docs.select("doc_id", "doc_len", F.explode("tokens").alias("term")).where("term is not null")
    return terms.groupBy("doc_id", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf")).select("term", "doc_id", "tf", "doc_len")


def term_stats_of(postings: DataFrame) -> DataFrame:
    """(term, df)."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def document_frequency_of(docs: DataFrame) -> DataFrame:
    """(term, df) straight from documents with lengths: one partially aggregated shuffle of terms."""
    terms = docs.select(F.explode(F.array_distinct("tokens")).alias("term")).where("term is not null")
    return term_stats_of(terms)


def corpus_stats_of(docs: DataFrame) -> DataFrame:
    """One row: n_docs, total_tokens, avgdl (0 for an empty collection)."""
    return docs.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.sum("doc_len"), F.lit(0)).cast("long").alias("total_tokens"),
        F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avgdl"),
    )


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass
class LexicalIndex:
    """The tables of an index; lazy, or read from a folder."""

    docs: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    buckets: int = 0  # folders of stored postings; 0: not stored

    @classmethod
    def build(cls, docs: DataFrame) -> LexicalIndex:
        """Index of documents (doc_id, url, title, content, tokens), one row an id."""
        full = with_lengths(docs)
        postings = postings_of(full)
        return cls(full, postings, document_frequency_of(full), corpus_stats_of(full))

    def save(self, folder: str) -> LexicalIndex:
        """Write the tables and return the stored index."""
        spark = self.docs.sparkSession
        self.docs.write.mode("overwrite").parquet(f"{folder}/docs")
        full = spark.read.parquet(f"{folder}/docs")
        corpus_stats_of(full).coalesce(1).write.mode("overwrite").parquet(f"{folder}/corpus_stats")
        document_frequency_of(full).write.mode("overwrite").parquet(f"{folder}/term_stats")
        tokens = spark.read.parquet(f"{folder}/corpus_stats").first()["total_tokens"]
        buckets = min(max(-(-tokens // BUCKET_TOKENS), LEAST_BUCKETS), MOST_BUCKETS)
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{folder}/layout")
        # no more hot terms than the collection has multiples of HOT_DOCS postings
        hot = spark.read.parquet(f"{folder}/term_stats").where(F.col("df") > HOT_DOCS).select("term", F.ceil(F.col("df") / HOT_DOCS).alias("parts"))
        rows = postings_of(full).withColumn("tb", bucket_of(F.col("term"), buckets)).join(F.broadcast(hot), "term", "left")
        part = F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1)))
        (
            rows.withColumn("part", part)
            .repartition("tb", "term", "part")
            .sortWithinPartitions("tb", "term")
            .select("term", "doc_id", "tf", "doc_len", "tb")
            .write.mode("overwrite")
            .partitionBy("tb")
            .parquet(f"{folder}/postings")
        )
        return self.load(spark, folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> LexicalIndex:
        read = lambda name: spark.read.parquet(f"{folder}/{name}")
        return cls(read("docs"), read("postings"), read("term_stats"), read("corpus_stats"), read("layout").first()["buckets"])

    # -- look-ups ---------------------------------------------------------------------------

    def postings_for(self, terms: list[str]) -> DataFrame:
        """Postings of the given terms; prunes folders and row groups of a stored index."""
        rows = self.postings.where(F.col("term").isin(terms) if terms else F.lit(False))
        if self.buckets and terms:  # the hashes are folded into literals, without a job
            rows = rows.where(F.col("tb").isin([bucket_of(F.lit(t), self.buckets) for t in terms]))
        return rows.select("term", "doc_id", "tf", "doc_len")

    def document(self, doc_id: str) -> DataFrame:
        return self.docs.where(F.col("doc_id") == doc_id)

    def documents(self) -> DataFrame:
        """All documents in order of their ids."""
        return self.docs.orderBy("doc_id")

    def document_count(self) -> int:
        return self.corpus_stats.first()["n_docs"]

    def average_length(self) -> float:
        return self.corpus_stats.first()["avgdl"]

    def document_frequency(self, term: str) -> int:
        row = self.term_stats.where(F.col("term") == term).first()
        return row["df"] if row else 0


def tokenize_query(spark: SparkSession, query: str) -> list[str]:
    """Tokens of a query, in order, repeats kept."""
    return spark.range(1).select(tokenize(F.lit(query)).alias("t")).first()["t"]
