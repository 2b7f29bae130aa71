"""Schemas of the engine's tables and messages."""

from pyspark.sql import types as T

#: One document; `fetched_at` travels as text, since an unset time is the year 1.
DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("fetched_at", T.StringType()),
    ]
)

#: One message of a document stream: a JSON object with these keys.
MESSAGE = "ID string, URL string, Title string, Content string, Tokens array<string>, FetchedAt string"

#: The file of a snapshot: one JSON object.
SNAPSHOT = "documents array<struct<id: string, url: string, title: string, tokens: array<string>, content: string>>"

POSTING = "term string, doc_id string, tf long, doc_len long"
SEARCH_RESULT = "doc_id string, score double, title string, snippet string, url string"
SEMANTIC_RESULT = "doc_id string, score double"
#: The unset time, as a message carries it.
ZERO_TIME = "0001-01-01T00:00:00Z"
