"""Sinks: messages, snapshots and search results."""

from __future__ import annotations

import json
import os
import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..log import Log, Silent
from .files import encode_messages


def write_messages(docs: DataFrame, path: str | None = None, options: dict[str, str] | None = None) -> None:
    """Append documents as JSON messages to a folder of lines, or to a topic of a broker."""
    rows = encode_messages(docs)
    if path is not None:
        rows.select("value").write.mode("append").text(path)
    else:
        rows.write.format("kafka").options(**(options or {})).save()


def topic_sink_options(brokers: list[str], topic: str) -> dict[str, str]:
    """Options of a topic that documents are written to: acknowledged by all replicas, sent every 10 ms."""
    return {"kafka.bootstrap.servers": ",".join(brokers), "topic": topic, "kafka.acks": "all", "kafka.linger.ms": "10"}


class MessageSink:
    """Takes documents and publishes them as messages; a failed write is logged and does not end the crawl."""

    def __init__(self, path: str | None = None, options: dict[str, str] | None = None, log: Log | None = None):
        self.path, self.options, self.log = path, options, log or Silent()

    def __call__(self, docs: DataFrame) -> None:
        try:
            write_messages(docs, self.path, self.options)
        except Exception as e:  # noqa: BLE001
            self.log.error("message_write_failed", e)


def snapshot_rows(docs: DataFrame) -> DataFrame:
    """(id, url, title, tokens, content) in order of the ids, as a snapshot holds them."""
    return docs.select(F.col("doc_id").alias("id"), "url", "title", "tokens", "content").orderBy("id")


def write_snapshot(docs: DataFrame, path: str) -> None:
    """Write one JSON file of all documents in order, then move it into place.

    Rows stream through the driver one partition at a time; the durable store is the index's tables,
    this file is an export for small collections.
    """
    if "://" in path and not path.startswith("file://"):
        return _write_remote(docs, path)
    path = re.sub(r"^file:/+", "/", path)
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, part = tempfile.mkstemp(dir=folder, suffix=".part")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write('{\n  "documents": [')
        first = True
        for row in snapshot_rows(docs).toLocalIterator():
            one = json.dumps(row.asDict(), ensure_ascii=False, indent=2).replace("\n", "\n    ")
            f.write(("" if first else ",") + "\n    " + one)
            first = False
        f.write("]\n}\n" if first else "\n  ]\n}\n")
    os.replace(part, path)


def _write_remote(docs: DataFrame, path: str) -> None:
    """The same file in another file system: written beside the driver, copied, then moved into place."""
    jvm, conf = docs.sparkSession._jvm, docs.sparkSession._jsc.hadoopConfiguration()
    hadoop = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = hadoop(path).getFileSystem(conf)
    with tempfile.TemporaryDirectory() as local:
        write_snapshot(docs, f"{local}/snapshot")
        fs.copyFromLocalFile(False, True, hadoop(f"file://{local}/snapshot"), hadoop(path + ".part"))
    fs.delete(hadoop(path), False)
    if not fs.rename(hadoop(path + ".part"), hadoop(path)):
        raise OSError(f"snapshot could not be moved to {path}")


def results_json(results: DataFrame | None) -> str:
    """Search results as a JSON list; null where there was nothing to search for."""
    if results is None:
        return "null\n"
    return json.dumps([r.asDict() for r in results.collect()], ensure_ascii=False) + "\n"
