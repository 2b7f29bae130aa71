"""Index maintenance from a stream of document messages.

Each micro-batch is appended to a log in a folder of its number, which a repeated run overwrites, so
delivery is effectively once.  The current documents are the latest version of each id in the log;
compaction folds the log into a base.  Undecodable messages are counted and skipped.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..log import Log, Silent
from ..operators.index import LexicalIndex, latest
from ..operators.metrics import Registry
from ..sources.files import decode_messages

LOG = "doc_id string, url string, title string, content string, tokens array<string>, fetched_at string, at timestamp, file string, n long, batch_id int"


def decoded(messages: DataFrame) -> DataFrame:
    """Documents of (value, seq) messages with the fields of seq; undecodable ones are left out."""
    d = messages.select(decode_messages(F.col("value")).alias("d"), "seq").where("d is not null")
    return d.select("d.*", "seq.*")


def current(spark: SparkSession, folder: str, snapshot: DataFrame | None = None) -> DataFrame:
    """The latest version of every document of the log; a snapshot counts as older than all of it."""
    docs = _log(spark, folder)
    if snapshot is not None:
        old = snapshot.select("doc_id", "url", "title", "content", "tokens", "fetched_at")
        old = old.withColumns({"at": F.lit(None).cast("timestamp"), "file": F.lit(None).cast("string"), "n": F.lit(-1).cast("long"), "batch_id": F.lit(-(2**31))})
        docs = docs.unionByName(old)
    version = ("batch_id", "at", "file", "n")
    return latest(docs, "doc_id", *version).drop(*version)


def _log(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder}/log"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(path)


class IndexUpdater:
    """Keeps a document log up to date, counts, and takes snapshots by elapsed time."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        snapshot: Callable[[DataFrame], None] | None = None,
        interval: float = 60.0,
        registry: Registry | None = None,
        clock: Callable[[], float] = time.monotonic,
        log: Log | None = None,
    ):
        self.spark, self.folder = spark, folder
        self.snapshot, self.interval, self.clock = snapshot, interval, clock
        self.registry = registry or Registry()
        self.log = log or Silent()
        self.skipped = 0
        self._last: float | None = None
        self._dirty = False

    def apply(self, messages: DataFrame, batch_id: int) -> None:
        """Handle one micro-batch."""
        counts = messages.select(decode_messages(F.col("value")).isNotNull().alias("ok")).agg(F.count_if("ok").alias("good"), F.count(F.lit(1)).alias("n")).first()
        decoded(messages).write.mode("overwrite").parquet(f"{self.folder}/log/batch_id={batch_id}")
        self.registry.index_updates += counts["good"]
        bad = counts["n"] - counts["good"]
        self.skipped += bad
        if bad:
            self.log.error("messages_undecodable", bad, batch=batch_id)
        self._dirty = self._dirty or counts["good"] > 0
        if counts["n"]:
            self._maybe_snapshot()

    def _maybe_snapshot(self) -> None:
        now = self.clock()
        if self.snapshot and self.interval > 0 and self._dirty and (self._last is None or now - self._last >= self.interval):
            try:
                self.snapshot(self.documents())
                self._last, self._dirty = now, False
            except Exception as e:  # noqa: BLE001 - tried again with the next message
                self.log.error("snapshot_failed", e)

    def add(self, docs: DataFrame) -> None:
        """Put documents into the log directly, as a sink of a crawl; they come after all batches so far."""
        top = _log(self.spark, self.folder).agg(F.max("batch_id")).first()[0]
        order = {"at": F.lit(None).cast("timestamp"), "file": F.lit(None).cast("string"), "n": F.monotonically_increasing_id()}
        rows = docs.select("doc_id", "url", "title", "content", "tokens", "fetched_at").withColumns(order)
        path = f"{self.folder}/log/batch_id={0 if top is None else max(top, -1) + 1}"
        rows.write.mode("overwrite").parquet(path)
        added = self.spark.read.parquet(path).count()
        self.registry.index_updates += added
        self._dirty = self._dirty or added > 0

    def documents(self) -> DataFrame:
        return current(self.spark, self.folder)

    def index(self) -> LexicalIndex:
        """Index of the current documents."""
        return LexicalIndex.build(self.documents().drop("fetched_at"))

    def start(self, messages: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        """Run over a stream of (value, seq); trigger as for a stream writer, e.g. availableNow=True."""
        writer = messages.writeStream.foreachBatch(lambda df, i: self.apply(df, i)).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()

    def stop(self, query: StreamingQuery) -> None:
        """Stop a run and write what the last snapshot lacks."""
        query.stop()
        if self.snapshot and self._dirty:
            self.snapshot(self.documents())
            self._dirty = False

    def compact(self) -> None:
        """Fold the log into a base that is older than every later batch.

        The base comes into place whole, before anything is deleted; at every moment the folders
        that are left give the same documents.
        """
        docs = _log(self.spark, self.folder)
        top = docs.agg(F.max("batch_id")).first()[0]
        if top is None or top < 0:
            return
        base, part = -top - 2, f"{self.folder}/compacting"
        latest(docs, "doc_id", "batch_id", "at", "file", "n").drop("batch_id").write.mode("overwrite").parquet(part)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        fs = path(self.folder).getFileSystem(conf)
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{self.folder}/log"))]
        old = sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch_id="))
        fs.rename(path(part), path(f"{self.folder}/log/batch_id={base}"))
        for n in old:  # earlier bases first, then the batches in order
            if n <= top:
                fs.delete(path(f"{self.folder}/log/batch_id={n}"), True)
