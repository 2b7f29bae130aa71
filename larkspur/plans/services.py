"""The runnable services: a crawl that publishes, an indexer, and a search service.

`python -m larkspur.plans.services orchestrate|indexer|search` runs one with the settings of the
environment (see `ServiceConfig`).
"""

from __future__ import annotations

import signal
import sys
import threading
from collections.abc import Callable
from dataclasses import dataclass
from http.server import ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import ORCHESTRATED, CrawlParams, SemanticParams, ServiceConfig
from ..log import Log
from ..operators.hybrid import SearchService
from ..operators.index import LexicalIndex
from ..operators.metrics import Registry
from ..operators.semantic import SemanticIndex
from ..sources.files import Resolve, local_seeds, message_stream, topic_options, try_load_snapshot
from ..sources.sinks import MessageSink, topic_sink_options, write_snapshot
from ..streaming.updater import IndexUpdater, current
from .api import make_server
from .crawl import CrawlResult, crawl


def address(text: str) -> tuple[str, int]:
    """(host, port) of host:port; no host means all interfaces."""
    host, _, port = text.rpartition(":")
    return host, int(port)


def serve(server: ThreadingHTTPServer) -> ThreadingHTTPServer:
    """Run a server on a thread of its own."""
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def orchestrate(
    spark: SparkSession,
    config: ServiceConfig,
    sink: Callable[[DataFrame], None] | None = None,
    resolve: Resolve | None = None,
    params: CrawlParams = ORCHESTRATED,
    registry: Registry | None = None,
    log: Log | None = None,
) -> CrawlResult:
    """Crawl from the configured seeds and publish every document."""
    log = log or Log()
    sink = sink or MessageSink(options=topic_sink_options(config.brokers, config.topic), log=log)
    seeds = local_seeds(config.seed_dir, config.seed_files)
    log.info("pipeline_start", seeds=len(seeds))
    got = crawl(spark.createDataFrame([(s,) for s in seeds], "url string"), resolve, params, sink, registry, log)
    log.info("pipeline_complete", pages=got.pages, duration_ms=round(got.seconds * 1000), topic=config.topic)
    return got


@dataclass
class Indexer:
    """A running indexer."""

    updater: IndexUpdater
    query: StreamingQuery
    metrics: ThreadingHTTPServer

    def stop(self) -> None:
        self.updater.stop(self.query)
        self.metrics.shutdown()
        self.updater.log.info("indexer_shutdown")


def start_indexer(spark: SparkSession, config: ServiceConfig, folder: str, messages: DataFrame | None = None, log: Log | None = None, **trigger: object) -> Indexer:
    """Follow the topic, keep the log of documents in `folder`, write snapshots, show the counters."""
    log = log or Log()
    registry = Registry()
    stream = message_stream(spark, topic_options(config.brokers, config.topic, config.indexer_group)) if messages is None else messages
    updater = IndexUpdater(spark, folder, lambda docs: write_snapshot(docs, config.snapshot_path), config.snapshot_interval, registry, log=log)
    metrics = serve(make_server(None, address(config.metrics_addr), registry, log))
    log.info("indexer_started", topic=config.topic, group=config.indexer_group, snapshot=config.snapshot_path)
    return Indexer(updater, updater.start(stream, f"{folder}/checkpoint", **trigger), metrics)


class LiveSearch(SearchService):
    """A search service over a snapshot and the documents streamed since; it reads the tables of its last refresh."""

    def __init__(self, spark: SparkSession, folder: str, snapshot: DataFrame | None, params: SemanticParams = SemanticParams()):
        self.spark, self.folder, self.snapshot, self.semantic_params = spark, folder, snapshot, params
        self.generation = 0
        self.refresh()

    def refresh(self) -> None:
        """Write the index of the current documents beside the last one, then turn to it."""
        docs = current(self.spark, self.folder, self.snapshot).drop("fetched_at")
        self.generation += 1
        to = f"{self.folder}/generation-{self.generation % 2}"
        super().__init__(LexicalIndex.build(docs).save(to), SemanticIndex.build(docs, self.semantic_params).save(to))


@dataclass
class Search:
    """A running search service."""

    service: LiveSearch
    updater: IndexUpdater
    query: StreamingQuery
    server: ThreadingHTTPServer

    def stop(self) -> None:
        self.query.stop()
        self.server.shutdown()


def start_search(spark: SparkSession, config: ServiceConfig, folder: str, messages: DataFrame | None = None, log: Log | None = None, **trigger: object) -> Search:
    """Load the snapshot, follow the topic, answer /search and /metrics."""
    log = log or Log()
    registry = Registry()
    service = LiveSearch(spark, folder, try_load_snapshot(spark, config.snapshot_path, log))
    stream = message_stream(spark, topic_options(config.brokers, config.topic, config.search_group)) if messages is None else messages

    class Following(IndexUpdater):
        def apply(self, messages: DataFrame, batch_id: int) -> None:
            before = self.registry.index_updates
            super().apply(messages, batch_id)
            if self.registry.index_updates > before:
                service.refresh()

    updater = Following(spark, folder, registry=registry, log=log)
    query = updater.start(stream, f"{folder}/checkpoint", **trigger)
    server = serve(make_server(service, address(config.search_addr), registry, log))
    log.info("search_started", addr=config.search_addr, group=config.search_group)
    return Search(service, updater, query, server)


def main(args: list[str]) -> int:
    if len(args) != 1 or args[0] not in ("orchestrate", "indexer", "search"):
        print(__doc__, file=sys.stderr)
        return 2
    from ..session import ensure_importable
    from ..storage import checkpoint_dir

    spark = SparkSession.builder.appName(f"larkspur-{args[0]}").getOrCreate()
    ensure_importable(spark)
    config, log = ServiceConfig.from_env(), Log()
    if args[0] == "orchestrate":
        orchestrate(spark, config, log=log)
        return 0
    start = start_indexer if args[0] == "indexer" else start_search
    running = start(spark, config, f"{checkpoint_dir(spark)}/{args[0]}", log=log)
    done = threading.Event()
    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, lambda *_: done.set())
    done.wait()
    running.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
