"""Crawl, snapshots, messages and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from larkspur.config import CrawlParams
from larkspur.operators.index import LexicalIndex
from larkspur.plans import catalog
from larkspur.plans.crawl import crawl
from larkspur.sources.files import decode_messages, encode_messages, fetching, from_table, load_snapshot, local_seeds, message_stream, read_files, try_load_snapshot
from larkspur.sources.sinks import write_messages, write_snapshot
from larkspur.streaming.updater import IndexUpdater, current

DOC = "doc_id string, url string, title string, content string, tokens array<string>, fetched_at string"


def graph(spark):
    """p0 -> p1, p2; p1 -> p0, p3; p2 -> p2, missing; p3 -> p4; p4 has no links; all with repeats."""
    edges = {0: [1, 2, 1], 1: [0, 3], 2: [2, 9], 3: [4], 4: []}
    rows = [(f"file:///g/p{i}", f"<title>P{i}</title>" + "".join(f"<a href='p{j}'>x</a>" for j in to)) for i, to in edges.items()]
    return spark.createDataFrame(rows, "url string, html string")


def test_crawl(spark):
    seeds = spark.createDataFrame([("file:///g/p0",), ("",), (None,), ("file:///g/p0",)], "url string")
    got = crawl(seeds, from_table(graph(spark)), CrawlParams(max_pages=50))
    assert {(r.title, r.depth) for r in got.documents.collect()} == {("P0", 0), ("P1", 1), ("P2", 1), ("P3", 2), ("P4", 3)}
    assert [(r.url, r.depth) for r in got.errors.collect()] == [("file:///g/p9", 2)]
    assert got.pages == 6 and got.visited.count() == 6


@pytest.mark.parametrize("budget,titles", [(1, ["P0"]), (2, ["P0", "P1"]), (4, ["P0", "P1", "P2", "P3"]), (5, ["P0", "P1", "P2", "P3"])])
def test_crawl_budget(spark, budget, titles):
    seeds = spark.createDataFrame([("file:///g/p0",)], "url string")
    got = crawl(seeds, from_table(graph(spark)), CrawlParams(max_pages=budget))
    assert sorted(r.title for r in got.documents.collect()) == titles and got.pages == budget


def test_crawl_without_budget(spark, tmp_path):
    """Every page is a seed whatever its id, and no number of links is cut: 1,200 links of one page, 150 pages."""
    links = "".join(f"<a href='x{i}'>x</a>" for i in range(1200))
    rows = [(i, f"file:///g/p{i}", links if i == 3 else f"<a href='p{i + 1}'>x</a>") for i in range(150)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.url: (r.depth, r.found) for r in catalog.queries()["crawl_all"](spark, str(tmp_path)).collect()}
    want = {f"file:///g/p{i}": (0, True) for i in range(150)} | {f"file:///g/{x}": (1, False) for x in ["p150", *(f"x{i}" for i in range(1200))]}
    assert got == want


def test_crawl_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<title>A</title><a href='b.html'>b</a> text")
    (tmp_path / "b.html").write_text("<title>B</title><a href='a.html'>a</a><a href='no.html'>n</a>")
    seeds = local_seeds(str(tmp_path), ["a.html"])
    assert seeds[0].startswith("file://") and local_seeds(str(tmp_path)) == local_seeds(str(tmp_path), ["a.html", "b.html"])
    got = crawl(spark.createDataFrame([(s,) for s in seeds], "url string"), fetching(politeness=0.0))
    assert sorted(r.title for r in got.documents.collect()) == ["A", "B"] and got.errors.count() == 1
    assert crawl(spark.createDataFrame([], "url string"), fetching(politeness=0.0)).documents.count() == 0
    assert read_files(spark, str(tmp_path)).where(F.col("url").endswith("a.html")).first()["html"].startswith("<title>A")


def docs(spark, *rows):
    return spark.createDataFrame([(*r, None) for r in rows], DOC)


def test_snapshot_round_trip(spark, tmp_path):
    path = str(tmp_path / "sub" / "s.json")
    df = docs(spark, ("b", "u", "t", "x ", ["x"]), ("a", None, "ü", "", None))
    write_snapshot(df, path)
    raw = json.load(open(path, encoding="utf-8"))
    assert [d["id"] for d in raw["documents"]] == ["a", "b"] and list(raw["documents"][0]) == ["id", "url", "title", "tokens", "content"]
    assert {tuple(map(str, r)) for r in load_snapshot(spark, path).collect()} == {tuple(map(str, r)) for r in df.collect()}
    write_snapshot(df.limit(0), path)
    assert load_snapshot(spark, path).count() == 0
    assert os.listdir(tmp_path / "sub") == ["s.json"]
    (tmp_path / "bad.json").write_text('{"documents": [')
    assert try_load_snapshot(spark, str(tmp_path / "bad.json")) is None and try_load_snapshot(spark, str(tmp_path / "none")) is None
    assert try_load_snapshot(spark, str(tmp_path)) is None


def test_messages(spark):
    good = json.dumps({"ID": "a", "URL": "u", "Title": "t", "Content": "c", "Tokens": None, "FetchedAt": "0001-01-01T00:00:00Z"})
    rows = spark.createDataFrame([(good,), ("{bad",), ('{"URL": "v"}',), ("",), (None,), ("[]",), ("7",)], "value string")
    got = [r.d for r in rows.select(decode_messages(F.col("value")).alias("d")).collect()]
    assert [d and d.doc_id for d in got] == ["a", None, "", None, None, None, None] and got[0].tokens is None and got[2].url == "v"
    back = json.loads(encode_messages(docs(spark, ("a", "u", "t", "c", None))).first()["value"])
    assert back == json.loads(good)


def test_stream(spark, tmp_path):
    folder, work = str(tmp_path / "in"), str(tmp_path / "work")
    write_messages(docs(spark, ("a", "u", "t", "one two", None), ("b", "u", "t", "two", None)).coalesce(1), folder)
    shots, now = [], [0.0]
    up = IndexUpdater(spark, work, lambda d: shots.append(d.count()), 60, clock=lambda: now[0])
    run = lambda: up.start(message_stream(spark, {"maxFilesPerTrigger": "1"}, folder), str(tmp_path / "ck"), availableNow=True).awaitTermination()
    run()
    assert shots == [2] and up.registry.index_updates == 2
    with open(os.path.join(folder, "part-later.txt"), "w") as f:
        f.write('{"ID": "a", "Content": "old"}\nnot json\n{"ID": "a", "Content": "three"}\n{"Content": "no id"}\n')
    run()
    assert up.skipped == 1 and shots == [2]
    want = {"a": "three", "b": "two", "": "no id"}
    assert {r.doc_id: r.content for r in up.documents().collect()} == want
    up.compact()
    assert {r.doc_id: r.content for r in up.documents().collect()} == want
    up.apply(spark.createDataFrame([('{"ID": "b", "Content": ""}', (None, "f", 0))], "value string, seq struct<at: timestamp, file: string, n: long>"), 7)
    up.apply(spark.createDataFrame([('{"ID": "b", "Content": "again"}', (None, "f", 0))], "value string, seq struct<at: timestamp, file: string, n: long>"), 7)
    assert {r.doc_id: r.content for r in up.documents().collect()} == want | {"b": "again"}
    up.compact()
    old = docs(spark, ("a", "u", "t", "stale", None), ("z", "u", "t", "only here", None))
    assert {r.doc_id: r.content for r in current(spark, work, old).collect()} == want | {"b": "again", "z": "only here"}
    index: LexicalIndex = up.index()
    assert index.document_count() == 3 and index.document_frequency("two") == 0
    now[0] = 61
    up.apply(spark.createDataFrame([('{"ID": "c"}', (None, "f", 0))], "value string, seq struct<at: timestamp, file: string, n: long>"), 8)
    assert shots == [2, 4]
