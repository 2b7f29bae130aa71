"""The services end to end, the logger, the sinks and the fetcher over http."""

import io
import json
import threading
import urllib.request
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from larkspur.config import CrawlParams, ServiceConfig
from larkspur.log import Log
from larkspur.operators.metrics import Registry
from larkspur.plans.services import address, main, orchestrate, serve, start_indexer, start_search
from larkspur.sources.files import fetch, fetching, load_snapshot, message_stream, topic_options
from larkspur.sources.sinks import MessageSink, topic_sink_options, write_snapshot
from larkspur.storage import checkpoint_dir
from larkspur.streaming.updater import IndexUpdater


def get(server, path):
    return urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}{path}").read().decode()


def test_crawl_to_search(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "a.html").write_text("<title>Quiet index</title><a href='b.html'>b</a> a stale shard of an index")
    (pages / "b.html").write_text("<title>Other</title><a href='a.html'>a</a><a href='none.html'>n</a> nothing of note")
    said = io.StringIO()
    log, registry = Log(said), Registry()
    config = replace(
        ServiceConfig.from_env({}), seed_dir=str(pages), seed_files=["a.html"], snapshot_path=str(tmp_path / "s.json"), metrics_addr="127.0.0.1:0", search_addr="127.0.0.1:0"
    )
    wire = str(tmp_path / "wire")
    got = orchestrate(spark, config, MessageSink(wire, log=log), fetching(politeness=0.0), CrawlParams(), registry, log)
    assert got.pages == 3 and registry.crawled == 2 and registry.crawl_errors == 1
    assert "crawler_documents_total 2" in registry.render() and "crawler_errors_total 1" in registry.render()

    stream = lambda: message_stream(spark, {}, wire)
    indexer = start_indexer(spark, config, str(tmp_path / "indexer"), stream(), log, availableNow=True)
    indexer.query.awaitTermination()
    assert "index_updates_total 2" in get(indexer.metrics, "/metrics")
    indexer.stop()
    assert load_snapshot(spark, config.snapshot_path).count() == 2

    (tmp_path / "wire2").mkdir()
    (tmp_path / "wire2" / "m.txt").write_text('{"ID": "c", "URL": "u", "Title": "New", "Content": "an index that came later"}\nnot a message\n')
    search = start_search(spark, config, str(tmp_path / "search"), message_stream(spark, {}, str(tmp_path / "wire2")), log, availableNow=True)
    search.query.awaitTermination()
    hits = json.loads(get(search.server, "/search?q=stale+index"))
    assert hits[0]["title"] == "Quiet index" and {h["title"] for h in hits} >= {"Quiet index", "New"}
    text = get(search.server, "/metrics")
    assert 'search_requests_total{status="ok"} 1' in text and "index_updates_total 1" in text
    search.stop()
    for event in ("pipeline_start", "pipeline_complete", "crawl_level", "indexer_started", "indexer_shutdown", "snapshot_loaded", "messages_undecodable", "search_started", "msg=search query='stale index' results="):
        assert event in said.getvalue()


def test_log_and_sinks(spark, tmp_path):
    said = io.StringIO()
    Log(said).info("hello", a=1, b="x")
    Log(said).error("oh", ValueError("no"), k=2)
    first, second = said.getvalue().splitlines()
    assert first.endswith("level=info msg=hello a=1 b=x") and second.endswith("level=error msg=oh error=no k=2")
    docs = spark.createDataFrame([("a", "u", "t", "c", None, None), ("b", "u", "t", "d", ["x"], None)], "doc_id string, url string, title string, content string, tokens array<string>, fetched_at string")
    MessageSink(options=topic_sink_options(["b:1"], "t"), log=Log(said))(docs)  # no connector here: logged, not raised
    assert "message_write_failed" in said.getvalue()
    up = IndexUpdater(spark, str(tmp_path / "ix"))  # a crawl's sink that indexes at once
    up.add(docs)
    up.add(docs.where("doc_id = 'a'").selectExpr("doc_id", "url", "title", "'newer' as content", "tokens", "fetched_at"))
    assert {r.doc_id: r.content for r in up.documents().collect()} == {"a": "newer", "b": "d"} and up.registry.index_updates == 3
    failing = IndexUpdater(spark, str(tmp_path / "ix2"), lambda _: 1 / 0, 1, log=Log(said))
    failing.apply(spark.createDataFrame([('{"ID": "c"}', (None, "f", 0))], "value string, seq struct<at: timestamp, file: string, n: long>"), 0)
    assert "snapshot_failed" in said.getvalue()
    write_snapshot(docs, f"file://{tmp_path}/x/s.json")
    assert load_snapshot(spark, f"{tmp_path}/x/s.json").count() == 2


def test_topics():
    got = topic_options(["a:1", "b:2"], "docs", "group")
    assert got["kafka.bootstrap.servers"] == "a:1,b:2" and got["subscribe"] == "docs" and got["kafka.group.id"] == "group"
    got = topic_sink_options(["a:1"], "docs")
    assert got["topic"] == "docs" and got["kafka.acks"] == "all" and got["kafka.linger.ms"] == "10"
    assert address(":8080") == ("", 8080) and address("h:1") == ("h", 1) and main([]) == 2


def test_fetch_over_http():
    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(404 if self.path == "/gone" else 200)
            self.end_headers()
            self.wfile.write(b"<title>x</title>")

        def log_message(self, *args):
            pass

    server = serve(ThreadingHTTPServer(("127.0.0.1", 0), Pages))
    base = f"http://127.0.0.1:{server.server_address[1]}"
    assert fetch(f"{base}/a") == "<title>x</title>"
    with pytest.raises(OSError, match="404"):
        fetch(f"{base}/gone")
    server.shutdown()


def test_shared_folder_is_asked_for():
    class Context:
        master = "spark://x:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
    assert threading.active_count() > 0
