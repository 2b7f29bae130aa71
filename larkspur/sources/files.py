"""Sources: seeds, fetchers, parsed pages, snapshots and messages."""

from __future__ import annotations

import glob
import os
import posixpath
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.text import document_id
from ..log import Log, Silent
from ..schema import MESSAGE, SNAPSHOT

Fetcher = Callable[[str], str]
Resolve = Callable[[DataFrame], DataFrame]


def local_seeds(base: str, names: Iterable[str] = ()) -> list[str]:
    """file:// urls of the named files of a folder, or of all its pages if none are named."""
    chosen = list(names) or [os.path.basename(p) for p in sorted(glob.glob(os.path.join(glob.escape(base), "*.html")))]
    return ["file://" + os.path.abspath(os.path.join(base, n)) for n in chosen]


def fetch(url: str, timeout: float = 10.0) -> str:
    """Body of a file or an http url; a status of 400 or more is an error."""
    if url.startswith("file://"):
        path = posixpath.normpath(urllib.parse.unquote(urllib.parse.urlparse(url).path))
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    try:
        with urllib.request.urlopen(urllib.request.Request(url), timeout=timeout) as answer:
            return answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        raise OSError(f"status {e.code} of {url}") from e


def fetching(fetcher: Fetcher = fetch, workers: int = 4, politeness: float = 0.05) -> Resolve:
    """Resolver that calls a fetcher for each url (url -> url, body, error), `workers` at a time."""

    def resolve(urls: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                bodies, errors = [], []
                for i, url in enumerate(pdf["url"]):
                    if i and politeness:
                        time.sleep(politeness)
                    try:
                        bodies.append(fetcher(url))
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001 - any failure of one page is that page's error
                        bodies.append(None)
                        errors.append(str(e))
                yield pd.DataFrame({"url": pdf["url"], "body": bodies, "error": errors})

        return urls.select("url").repartition(workers).mapInPandas(run, "url string, body string, error string")

    return resolve


def from_table(pages: DataFrame, url: str = "url", body: str = "html") -> Resolve:
    """Resolver that looks bodies up in a table; a url that is not there is an error.

    Of several bodies of one url the greatest is taken, so the result is the same on every run.
    """
    known = pages.groupBy(F.col(url).alias("url")).agg(F.max(F.coalesce(F.col(body), F.lit(""))).alias("body"))

    def resolve(urls: DataFrame) -> DataFrame:
        found = urls.select("url").join(known, "url", "left")
        return found.select("url", "body", F.when(F.col("body").isNull(), "not found").alias("error"))

    return resolve


def parse_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(doc_id, url, title, content, tokens, fetched_at, links) of raw pages; null html is an empty page."""
    u, h = F.col(url), F.coalesce(F.col(html), F.lit(""))
    return pages.select(
        document_id(u).alias("doc_id"),
        u.alias("url"),
        H.title(h).alias("title"),
        H.text(h).alias("content"),
        F.lit(None).cast("array<string>").alias("tokens"),
        F.lit(None).cast("string").alias("fetched_at"),
        H.links(u, h).alias("links"),
    )


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(url, html) of whole files."""
    return spark.read.text(paths, wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:///").alias("url"), F.col("value").alias("html")
    )


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a snapshot file, one JSON object with a list `documents`."""
    raw = spark.read.schema(SNAPSHOT).option("mode", "FAILFAST").json(path, multiLine=True)
    rows = raw.select(F.explode("documents").alias("d")).select("d.*")
    return rows.select(
        F.coalesce("id", F.lit("")).alias("doc_id"), "url", "title", "content", "tokens", F.lit(None).cast("string").alias("fetched_at")
    )


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a file lies there, in whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p)) and not fs.getFileStatus(p).isDirectory()


def try_load_snapshot(spark: SparkSession, path: str, log: Log | None = None) -> DataFrame | None:
    """The snapshot's documents; None if there is no such file or it cannot be read, which is logged."""
    log = log or Silent()
    try:
        if not is_file(spark, path):
            log.info("snapshot_missing", path=path)
            return None
        docs = load_snapshot(spark, path)
        log.info("snapshot_loaded", path=path, documents=docs.count())
        return docs
    except Exception as e:  # noqa: BLE001 - an unreadable snapshot leaves the service empty
        log.error("snapshot_load_failed", e, path=path)
        return None


def decode_messages(value: Column) -> Column:
    """The document of a JSON message, or null for one that cannot be decoded; a missing ID is an empty id."""
    d = F.from_json(value, MESSAGE + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    good = d["_bad"].isNull() & value.isNotNull() & F.trim(value).startswith("{")
    return F.when(
        good,
        F.struct(
            F.coalesce(d["ID"], F.lit("")).alias("doc_id"),
            F.coalesce(d["URL"], F.lit("")).alias("url"),
            F.coalesce(d["Title"], F.lit("")).alias("title"),
            F.coalesce(d["Content"], F.lit("")).alias("content"),
            d["Tokens"].alias("tokens"),
            d["FetchedAt"].alias("fetched_at"),
        ),
    )


def encode_messages(docs: DataFrame, *keep: str) -> DataFrame:
    """(key, value): each document as a JSON message, keyed by its id so that its updates keep their order; other columns may be kept."""
    from ..schema import ZERO_TIME

    body = F.struct(
        F.col("doc_id").alias("ID"),
        F.coalesce("url", F.lit("")).alias("URL"),
        F.coalesce("title", F.lit("")).alias("Title"),
        F.coalesce("content", F.lit("")).alias("Content"),
        F.col("tokens").alias("Tokens"),
        F.coalesce("fetched_at", F.lit(ZERO_TIME)).alias("FetchedAt"),
    )
    return docs.select(F.col("doc_id").alias("key"), F.to_json(body, {"ignoreNullFields": "false"}).alias("value"), *keep)


def topic_options(brokers: list[str], topic: str, group: str) -> dict[str, str]:
    """Options of a topic read by a consumer group."""
    return {"kafka.bootstrap.servers": ",".join(brokers), "subscribe": topic, "kafka.group.id": group, "startingOffsets": "earliest", "failOnDataLoss": "false"}


def message_stream(spark: SparkSession, options: dict[str, str], files: str | None = None) -> DataFrame:
    """A streaming table (value, seq): lines of files that arrive in a folder, or a topic of a broker.

    seq orders the messages: file time, file and line; or partition and offset.
    """
    if files is not None:
        lines = spark.readStream.format("text").options(**options).option("wholetext", "true").load(files)
        split = lines.select(
            F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "value")
        )
        return split.where("trim(value) <> ''").select("value", F.struct("at", "file", F.col("n").cast("long").alias("n")).alias("seq"))
    topic = spark.readStream.format("kafka").options(**({"startingOffsets": "earliest"} | options)).load()
    return topic.select(
        F.col("value").cast("string").alias("value"),
        F.struct(F.col("timestamp").alias("at"), F.col("partition").cast("string").alias("file"), F.col("offset").alias("n")).alias("seq"),
    )
