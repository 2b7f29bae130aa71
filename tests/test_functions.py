"""Scalar functions against plain Python."""

import hashlib
import re
import string

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.config import CrawlParams, SemanticParams, ServiceConfig, parse_duration, split_and_trim
from larkspur.functions import html as H
from larkspur.functions import text as T
from larkspur.functions import vector as V
from larkspur.functions.sql import register
from larkspur.operators.semantic import hash_token

LAX = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def column(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


def py_tokens(text):
    return [t.lower() for t in re.findall("[a-zA-Z0-9]+", text or "")]


def test_tokenize_examples(spark):
    texts = ["Tail latency hurts Search.", "café Ünder_score", "", None, "...", "a1-B2 a1"]
    assert column(spark, texts, T.tokenize) == [["tail", "latency", "hurts", "search"], ["caf", "nder", "score"], [], [], [], ["a1", "b2", "a1"]]


@LAX
@given(st.lists(st.text(max_size=40).filter(lambda s: "\x00" not in s and not re.search("[\ud800-\udfff]", s)), min_size=1, max_size=20))
def test_tokenize_property(spark, texts):
    assert column(spark, texts, T.tokenize) == [py_tokens(t) for t in texts]


@LAX
@given(st.lists(st.text(alphabet=string.ascii_lowercase + "é0", max_size=12), min_size=1, max_size=20))
def test_fnv(spark, texts):
    assert column(spark, texts, T.fnv1a) == [hash_token(t) for t in texts]


def test_supplied_tokens_are_kept(spark):
    df = spark.createDataFrame([(["Mixed", "Case"], "other"), ([], "some text"), (None, "x"), (None, None)], "a array<string>, c string")
    got = [r[0] for r in df.select(T.tokens_or(F.col("a"), F.col("c"))).collect()]
    assert got == [["Mixed", "Case"], ["some", "text"], ["x"], []]


def py_snippet(content, tokens):
    if not content:
        return ""
    low = content.lower()
    for t in tokens:
        p = low.find(t)
        if p >= 0:
            return content[max(0, p - 40) : min(len(content), p + 40)]
    return content[:80]


@pytest.mark.parametrize("n", [0, 1, 39, 79, 80, 81, 200])
def test_snippet(spark, n):
    body = ("lorem ipsum dolor " * 20)[:n]
    for content in (body, body + "needle", "needle" + body, body + "Needle" + body, "ü" * n + "needle" + "é" * n):
        for tokens in (["needle"], ["absent", "dol"], ["zzz"]):
            words = F.array(*(F.lit(t) for t in tokens))
            assert one(spark, T.snippet(F.col("c"), words), c=content) == py_snippet(content, tokens)
    assert one(spark, T.snippet(F.col("c"), F.array(F.lit("a"))), c=None) == ""


def test_document_id(spark):
    assert one(spark, T.document_id(F.col("u")), u="file:///tmp/ä") == hashlib.sha1("file:///tmp/ä".encode()).hexdigest()


def test_trim_space(spark):
    assert column(spark, ["  a b　\t", "\x0b\x85x", " "], T.trim_space) == ["a b", "x", ""]


def py_join(base, link):
    if base == "":
        return link
    if base.startswith("file://"):
        return base[: base.rfind("/") + 1] + link
    return base.rstrip("/") + "/" + link.lstrip("/")


def test_links(spark):
    bases = ["", "file:///tmp/a.html", "http://h/x", "http://h/x///", "https://h?q=1"]
    hrefs = ["http://o/", "https://o", "file:///z", "HTTP://o", "/x", "#f", "mailto:a@b", "", "//y", "n.html"]
    rows = [(b, h) for b in bases for h in hrefs]
    df = spark.createDataFrame(rows, "b string, h string")
    got = [r[2] for r in df.select("b", "h", H.resolve_link(F.col("b"), F.col("h"))).collect()]
    want = [h if h.startswith(("http://", "https://", "file://")) else py_join(b, h) for b, h in rows]
    assert got == want


def test_html(spark):
    page = (
        "<html><head><title> </title><title>Sample &amp; more</title><script>var a = '<b>&amp;';</script></head>"
        "<body>one <b>two</b><!-- hidden <a href='no'> --> three<a class=x href='next.html'>go</a><a HREF=\"/q?a=1&amp;b=2\">&#228;&#x41;</a>"
        "<a name=y>none</a><style>p > a {}</style></body></html>"
    )
    assert one(spark, H.title(F.col("h")), h=page) == "Sample & more"
    assert one(spark, H.text(F.col("h")), h=page) == "Sample & more var a = '<b>&amp;'; one two three go äA none p > a {} "
    assert one(spark, H.hrefs(F.col("h")), h=page) == ["next.html", "/q?a=1&b=2"]
    assert one(spark, H.links(F.col("u"), F.col("h")), u="file:///tmp/sample.html", h="<a href=\"next.html\">") == ["file:///tmp/next.html"]
    for empty in (None, ""):
        assert one(spark, H.title(F.col("h")), h=empty) == ""
        assert one(spark, H.text(F.col("h")), h=empty) == ""
        assert one(spark, H.hrefs(F.col("h")), h=empty) == []


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0], [2.0, 0.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    got = df.select(V.dot(F.col("a"), F.col("b")), V.magnitude(F.col("a")), V.cosine(F.col("a"), F.col("b"))).collect()
    assert [tuple(round(x, 6) for x in r) for r in got] == [(2.0, 3.0, round(2 / 6, 6)), (0.0, 0.0, 0.0)]


def test_sql_functions(spark):
    assert "tokenize" in register(spark)
    assert spark.sql("SELECT tokenize('A b') AS t").first()["t"] == ["a", "b"]
    assert {(r.term, r.times) for r in spark.sql("SELECT * FROM query_terms('x y X')").collect()} == {("x", 2), ("y", 1)}
    assert spark.sql("SELECT idf(4, 2) AS i").first()["i"] == 0.0
    assert spark.sql("SELECT bm25_weight(1, 10, 10D) AS w").first()["w"] == 1.0


def test_config():
    assert split_and_trim(" a, ,b ,") == ["a", "b"]
    assert parse_duration("1m30s", 5) == 90 and parse_duration("250ms", 5) == 0.25 and parse_duration("bad", 5) == 5 and parse_duration("", 5) == 5
    assert CrawlParams(0, 0, 0) == CrawlParams(4, 0.05, 100)
    assert SemanticParams(0, 0, 0) == SemanticParams()
    c = ServiceConfig.from_env({"KAFKA_BROKERS": "a:1, b:2", "SNAPSHOT_INTERVAL": "x", "INDEXER_GROUP": ""})
    assert c.brokers == ["a:1", "b:2"] and c.snapshot_interval == 60 and c.indexer_group == "indexer-service"


REFERENCES = {
    "&pound;5 &#128512; &euro; &trade; &Eacute; caf&eacute;": "£5 \U0001f600 € ™ É café",
    "&amp;lt; &lt;b&gt; &copy2021 &notit; &notin; &#x41; &#65 &#150;": "&lt; <b> ©2021 ¬it; ∉ A A –",
    "&#0; &#xD800; &#99999999999; &#x; &; & x && &nosuch; &Aacute &nbsp;x": "\ufffd \ufffd \ufffd &#x; &; & x && &nosuch; Á \xa0x",
    "&NotEqualTilde; &fjlig; plain": "≂̸ fj plain",
    "&#x1F469;&#x200D;&#x1F527;": "\U0001f469\u200d\U0001f527",
    "": "",
}


def test_character_references(spark):
    rows = spark.createDataFrame([(t,) for t in [*REFERENCES, None]], "t string").select("t", H.unescape(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in rows} == {**REFERENCES, None: None}
    page = "<title>&Uuml;ber &#128512;</title><p>5 &pound; &hellip;</p><a href='?a=1&copy=2&amp;b=3&lt;&copyx&#x41;'>x</a>"
    got = spark.createDataFrame([(page,)], "h string").select(H.title("h").alias("t"), H.text(F.col("h")).alias("x"), H.hrefs(F.col("h")).alias("l")).first()
    assert got.t == "Über \U0001f600" and got.x == "Über \U0001f600 5 £ … x " and got.l == ["?a=1&copy=2&b=3<&copyxA"]
