"""The engine's functions for use in SQL; Catalyst inlines their bodies."""

from pyspark.sql import SparkSession

FUNCTIONS = {
    "tokenize(s STRING) RETURNS ARRAY<STRING>": "transform(regexp_extract_all(coalesce(s, ''), '[a-zA-Z0-9]+', 0), x -> lower(x))",
    "query_terms(q STRING) RETURNS TABLE(term STRING, times BIGINT)": (
        "SELECT term, count(*) FROM (SELECT explode(transform(regexp_extract_all(coalesce(q, ''), '[a-zA-Z0-9]+', 0), x -> lower(x))) AS term) GROUP BY term"
    ),
    "document_id(url STRING) RETURNS STRING": "sha1(url)",
    "idf(n_docs BIGINT, df BIGINT) RETURNS DOUBLE": "greatest(0D, ln((n_docs - df + 0.5D) / (df + 0.5D)))",
    "bm25_weight(tf BIGINT, doc_len BIGINT, avgdl DOUBLE) RETURNS DOUBLE": (
        "tf * 2.5D / (tf + 1.5D * (0.25D + 0.75D * (if(doc_len = 0, if(avgdl = 0, 1D, avgdl), doc_len) / if(avgdl = 0, 1D, avgdl))))"
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions as temporary ones of the session; returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.partition("(")[0] for h in FUNCTIONS]
