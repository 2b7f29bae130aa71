"""The operators for training data against brute force, on small dirty tables."""

import base64
import collections
import itertools
import math
import os
import random
import unicodedata as ud

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import kernels as K
from larkspur.llm import main_body as B
from larkspur.llm import near_duplicates as N
from larkspur.llm import visual_form as V
from larkspur.llm.frequency import count_terms, mark_terms
from larkspur.llm.history import HistoryIndex, cut, rows_without_new_content
from larkspur.llm.main_body import main_body, not_main_body
from larkspur.llm.packing import pack
from larkspur.llm.repeated_lines import repeated_lines, site_of, without_repeated_lines
from larkspur.llm.tokenizer import LONG, VOCABULARY, encode_corpus, vocabulary
from larkspur.llm.vptree import Forest, VPTree, hamming

from .helpers import edited, families, folded_line, jaccard, look, prose, shingle_set, words

LAX = settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
TEXT = st.text(alphabet=st.characters(codec="utf-8"), max_size=60)
NASTY = st.text(alphabet="aZ9' \n\t\r.,é日 ​’s'lvre", max_size=40)


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def everything(df):
    return sorted(tuple(r) for r in df.collect())


# --- kernels -------------------------------------------------------------------------------------


@LAX
@given(st.lists(st.one_of(TEXT, NASTY), max_size=8))
def test_words_and_shingles(texts):
    raw, off = K.string_buffer(pa.array(texts, pa.string()))
    low, s, e, first = K.ascii_words(raw, off)
    got = [[low[a:b].tobytes().decode() for a, b in zip(s[i:j], e[i:j])] for i, j in zip(first[:-1], first[1:])]
    assert got == [words(t) for t in texts]
    values, to = K.shingles(raw, off, 3)
    assert np.diff(to).tolist() == [max(len(words(t)) - 2, 0) for t in texts]
    distinct, to = K.distinct_per_row(values, to)
    assert np.diff(to).tolist() == [len(shingle_set(t, 3)) for t in texts]


@LAX
@given(st.lists(st.one_of(TEXT, st.none()), max_size=8))
def test_code_points(texts):
    cps, off = K.code_points(pa.array(texts, pa.string()))
    assert K.strings_from_code_points(cps, off) == [t or "" for t in texts]


def test_distinct_segments():
    raw = np.frombuffer(b"abcabcabd", np.uint8)
    codes, rep = K.distinct_segments(raw, np.array([0, 3, 6, 6]), np.array([3, 6, 9, 8]))
    assert codes[0] == codes[1] and len({*codes.tolist()}) == 3 and len(rep) == 3


# --- problem 1 -----------------------------------------------------------------------------------


@pytest.mark.parametrize("n,r", [(10, 20), (700, 0), (700, 12), (700, 40), (700, 75)])
def test_vantage_point_tree(n, r):
    rng = np.random.default_rng(n + r)
    pts = rng.integers(0, 2**63, (n, 3), dtype=np.uint64)
    pts[n // 2 :] = pts[: n - n // 2] ^ (np.uint64(1) << rng.integers(0, 63, (n - n // 2, 3)).astype(np.uint64))
    got = {(int(q), int(p)) for a, b in VPTree(pts).within(pts, r) for q, p in zip(a, b)}
    full = hamming(pts[:, None, :], pts[None, :, :])
    assert got == {(int(i), int(j)) for i, j in np.argwhere(full <= r)}


@pytest.mark.parametrize("r", [0, 40, 75, 110, 192])
def test_forest(r):
    rng = np.random.default_rng(r)
    base = rng.integers(0, 2**63, (40, 3), dtype=np.uint64)
    pts = base[rng.integers(0, 40, 700)]
    pts[:, 0] ^= np.uint64(1) << rng.integers(0, 63, 700).astype(np.uint64)
    length = np.array([1, 2, 3, 0, 4, 5, 90, 1, 594])
    start = np.cumsum(length) - length
    forest = Forest(pts, r)
    got = [tuple(sorted(p)) for p in zip(*(x.tolist() for x in forest.pairs(start, length)))]
    full = hamming(pts[:, None, :], pts[None, :, :])
    want = {(i, j) for s, n in zip(start.tolist(), length.tolist()) for i in range(s, s + n) for j in range(i + 1, s + n) if full[i, j] <= r}
    assert len(got) == len(set(got)) and set(got) == want
    if r <= 40:  # groups are told apart
        assert forest.compared < 0.4 * (length * (length - 1) // 2).sum()


def brute_pairs(rows, threshold, width):
    seen = {}
    for i, t in rows:
        if i is not None and t is not None:
            seen.setdefault(i, shingle_set(t, width))
    return sorted(
        (a, b) for a, b in itertools.combinations(sorted(seen), 2) if seen[a] and seen[b] and jaccard(seen[a], seen[b]) >= threshold
    )


@pytest.mark.parametrize("threshold,width", [(0.5, 3), (0.8, 5)])
def test_near_duplicates(spark, threshold, width, monkeypatch):
    texts = families() + ["", " ", "one two", "one two three four five", "One, two! THREE four five", None, "same same same same same same " * 500]
    rows = [(f"d{i:03}", t) for i, t in enumerate(texts)] + [("d000", texts[0]), (None, texts[0]), ("copy", texts[3]), ("copy2", texts[3])]
    df = table(spark, rows, "id string, content string").withColumns({"h": F.lit(1), "k": F.lit("x"), "bands": F.lit(2)})
    assert everything(N.near_duplicate_pairs(df, threshold=threshold, width=width)) == brute_pairs(rows, threshold, width)
    assert N.near_duplicate_pairs(df.limit(0)).collect() == []


def test_near_duplicates_in_hot_shards(spark, monkeypatch):
    """Shards beyond the limit are searched block against block and lose nothing."""
    rng = random.Random(5)
    base = prose(rng, 120)
    rows = [(f"d{i:03}", edited(rng, base, 4)) for i in range(60)]
    df = table(spark, rows, "id string, content string")
    want = brute_pairs(rows, 0.5, 3)
    assert len(want) > 500
    monkeypatch.setattr(N, "LIMIT", 7)
    # a session's workers import the module afresh, so the limit travels with the patched closure
    sig = N.signatures(df, "id", "content", 3)
    pairs = N.candidate_pairs(sig, N.radius(0.5))
    over = sig.select(F.lit(1).cast("long").alias("shard"), "h", *N._FP)
    blocks = N._large_shards(over, N.radius(0.5)).distinct()
    names = {r.h: r.k for r in sig.select("h", "k").collect()}
    for got in (pairs, blocks):
        found = {tuple(sorted((names[r.a], names[r.b]))) for r in got.collect()}
        assert set(want) <= found


# --- problem 2 -----------------------------------------------------------------------------------


def pages(rng):
    legal = "All rights reserved. " * 40  # longer than a chunk
    rows = []
    for i in range(24):
        lines = [prose(rng, 12), "  Share  THIS page ", "", prose(rng, 60), legal + ("." if i % 2 else ""), "rare line" if i < 7 else "rare other", "\t", "Home"]
        rows.append((f"p{i:02}", f"https://www.Site{i % 2}.example:80/{i}", ("\r\n" if i % 3 else "\n").join(lines) + " "))
    rows += [("n0", "file:///x", "Home"), ("n1", None, "Home"), ("n2", "https://site0.example", None), ("n3", "http://site0.example/", "")]
    return rows + [("p00", *rows[0][1:])] * 9


def brute_repeated(rows, min_docs):
    once = {r[0]: r for r in rows}.values()
    held = collections.defaultdict(set)
    out = []
    for i, u, c in once:
        if c is None or not u or not u.lower().startswith(("http://", "https://")):
            continue
        site = u.lower().split("/")[2].split(":")[0].removeprefix("www.")
        for n, line in enumerate(c.split("\n"), 1):
            if folded_line(line):
                held[site, folded_line(line)].add(i)
                out.append((i, n, site, folded_line(line)))
    return sorted((i, n) for i, n, s, f in out if len(held[s, f]) >= min_docs)


@pytest.mark.parametrize("min_docs", [1, 2, 8])
def test_repeated_lines(spark, min_docs):
    rows = pages(random.Random(2))
    df = table(spark, rows, "id string, url string, content string").withColumns({"site": F.lit(1), "k": F.lit(1), "chunk": F.lit(1)})
    want = brute_repeated(rows, min_docs)
    assert everything(repeated_lines(df, min_docs=min_docs)) == want
    cut = collections.defaultdict(set)
    for i, n in want:
        cut[i].add(n)
    got = {r.id: r.content for r in without_repeated_lines(df, min_docs=min_docs).collect()}
    for i, _, c in rows:
        keep = None if c is None else "\n".join(x for n, x in enumerate(c.split("\n"), 1) if n not in cut[i])
        assert got[i] == keep
    assert repeated_lines(df.limit(0)).collect() == []


def test_sites(spark):
    urls = ["HTTPS://WWW.A.Example:8443/x", "http://a.example?q", "http://u:p@b.example/", "ftp://c", "", None, "https://www.", " http://d.example#x"]
    got = [r[0] for r in table(spark, [(u,) for u in urls], "u string").select(site_of(F.col("u"))).collect()]
    assert got == ["a.example", "a.example", "b.example", None, None, None, None, "d.example"]


# --- problem 3 -----------------------------------------------------------------------------------


def test_frequencies(spark):
    rng = random.Random(3)
    rows = [(f"d{i}", [f"t{int(rng.paretovariate(0.6)) % 90}" for _ in range(rng.randrange(30))]) for i in range(80)]
    rows += [("d0", rows[0][1])] * 3 + [("n0", None), ("n1", []), ("n2", ["", None, "T1", "t1", "ü", "ü"]), (None, ["z"])]
    df = table(spark, rows, "id string, tokens array<string>").withColumns({"term": F.lit(1), "k": F.lit(1), "range": F.lit(1)})
    occ, rec = collections.Counter(), collections.Counter()
    once = dict(rows)
    for t in once.values():
        kept = [x for x in t or [] if x]
        occ.update(kept)
        rec.update(set(kept))
    got = count_terms(df, ranges=5).collect()
    assert sorted((r.term, r.occurrences, r.records) for r in got) == sorted((t, occ[t], rec[t]) for t in occ)
    assert len({r.term_id for r in got}) == len(got)
    marks = sorted((t, "rare" if n <= 2 else "common") for t, n in rec.items() if n <= 2 or n > 0.2 * len(once))
    assert everything(mark_terms(df)) == marks
    assert count_terms(df.limit(0)).collect() == [] and mark_terms(df.limit(0)).collect() == []


# --- problem 4 -----------------------------------------------------------------------------------

def web_pages(n=80, seed=8):
    """Pages whose frame is worded as no list could know, and the numbers of their body lines."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3))
    shared = [word() for _ in range(60)]
    prose = lambda: f"{word().title()}, {' '.join(rng.choice(shared) for _ in range(14))}, {word()} {word()}."
    out = []
    for i in range(n):
        title = f"{rng.choice(shared).title()} {rng.choice(shared)} beyond {word()} at {word().title()}"
        lines = [
            (0, "Zimbo plents our frabs and kettles for all of you."),
            (0, "Oakum | Plimm | Quixo | Zorba"),
            (0, f"Oakum / Plimm / {title}"),
            (1, title),
            (0, f"Wrought of {word().title()} {word().title()}, {i % 28 + 1}/3/2021"),
            (1, prose()),
            (1, "Outcomes"),
            (1, prose() * 2),
            (1, f"* {rng.choice(shared)} {word()}"),
            (1, f"{word()} | {i} ms | {i * 7} {word()} | {word()}"),
            (0, "Pass it on, dear folk – Inkit"),
            (1, prose()),
            (0, "Peruse ye also"),
            *((0, f"{rng.choice(shared).title()} {rng.choice(shared)} beyond {word()} at {word().title()}") for _ in range(1 + i % 12)),
            (0, f"Peruse: {rng.choice(shared).title()} {word()} at {word().title()}"),
            (0, "Hereby and forthwith all is kept by its makers."),
            (0, "Legalia"),
            (0, "Plimm"),
        ]
        if i % 4 == 0:
            lines.insert(7, (1, ""))
        out.append((f"d{i:03}", title if i % 5 else None, ("\r\n" if i % 3 else "\n").join(x for _, x in lines) + " ", [k for k, _ in lines]))
    return out


def test_main_body(spark):
    pages = web_pages()
    rows = [p[:3] for p in pages] + [pages[0][:3], ("n1", None, None), ("n2", "", ""), ("n3", "x", " \n\t\n"), (None, "t", "One line, and its end.")]
    df = table(spark, rows, "id string, title string, content string").withColumns({"line": F.lit(1), "k": F.lit(1), "body": F.lit(1)})
    lines = {(i, n) for i, _, c, _ in pages for n, x in enumerate(c.split("\n"), 1) if x.strip()}
    body = {(i, n) for i, _, _, ks in pages for n, k in enumerate(ks, 1) if k} & lines
    out = {(r.id, r.line_no) for r in not_main_body(df).collect()}
    kept = {(r.id, r.line_no): r.line for r in main_body(df).collect()}
    assert out.isdisjoint(kept) and {x for x in out | set(kept) if x[0]} == lines | {x for x in out | set(kept) if x[0] in ("n1", "n2", "n3")}
    assert not any(x[0] in ("n1", "n2", "n3") for x in out | set(kept)) and kept[None, 1].startswith("One line")
    assert len(out & (lines - body)) >= 0.97 * len(lines - body) and len(out & body) <= 0.03 * len(body)
    assert kept["d001", 4] == pages[1][1]
    assert not_main_body(df.limit(0)).collect() == []


def test_points_decide(monkeypatch):
    pages = web_pages()
    texts = [p[2] for p in pages]
    words = collections.Counter(w for t in texts for w in {w for x in B._short_lines(t) for w in B._WORDS.findall(x)})
    common = frozenset(w for w, n in words.items() if n >= 6)
    shapes = collections.Counter(x for t in texts for x in {B.template(x, common) for x in B._short_lines(t)})
    leads = collections.Counter(x for t in texts for x in {B.lead(x) for x in B._short_lines(t)} - {""})
    frame = B.Frame(common, frozenset(x for x, n in shapes.items() if n >= 6), frozenset(x for x, n in leads.items() if n >= 6))
    masks = lambda: [B.body_mask(t.split("\n"), h, frame) for _, h, t, _ in pages]
    scored = masks()
    monkeypatch.setattr(B, "FLOOR", 0.0)
    free = masks()
    wrong = lambda ms: sum(bool(k) != x for m, (_, _, _, ks) in zip(ms, pages) for x, k in zip(m, ks) if x is not None)
    assert wrong(scored) * 10 < wrong(free)


def test_body_of_odd_pages():
    none = B.Frame()
    assert B.body_mask([""], None, none) == [None]
    assert B.body_mask(["Title", "", "Login", "word"], "Title", none) == [True, None, True, True]
    long = "A very long sentence, with commas, " * 5000 + "ends."
    assert B.body_mask(["Home", "Terms", long, "Terms", "Legal"], None, none) == [False, False, True, False, False]
    wrapped = ["A title", "A paragraph that the page has wrapped after some of its", "words goes", "on and ends here.", "x"]
    assert B.body_mask(wrapped, "A title", none)[:4] == [True] * 4
    titles = [f"Another index beyond reach at Paris {n}" for n in range(40)]
    assert B.template("keep reading 5", frozenset(["keep"])) == "keep # 0"
    frame = B.Frame(common=frozenset(["keep", "reading"]), templates=frozenset(["keep reading"]))
    assert B.body_mask(["A title", "A sentence of the body, and its end.", "Keep reading", *titles], "A title", frame) == [True, True] + [False] * 41


# --- problem 5 -----------------------------------------------------------------------------------


def brute_cases(history, batch_rows, threshold, width):
    accepted = [s for s in (shingle_set(t, width) for t in history) if s]
    out = []
    for _, seq, t in sorted(r for r in batch_rows if r[1] is not None):
        s = shingle_set(t, width)
        if not s:
            continue
        if any(jaccard(s, a) >= threshold for a in accepted):
            out.append((seq,))
        else:
            accepted.append(s)
    return sorted(out)


def test_history(spark):
    rng = random.Random(11)
    base = [prose(rng, 90, 5000) for _ in range(10)]
    history = base[:5] + [base[0], None, "", " ", "two words"]
    rows, seq = [], 0
    chain = base[7]
    for n in (1, 2, 3):
        for i in range(30):
            seq += 1
            kind = i % 6
            if kind == 0:
                t = edited(rng, rng.choice(base), 3)
            elif kind == 1:
                t = rng.choice(base)
            elif kind == 2:
                t = prose(rng, 60, 5000)
            elif kind == 3:
                chain = edited(rng, chain, 11)  # similar to its neighbours in the chain only
                t = chain
            elif kind == 4:
                t = rng.choice([None, "", "\n ", "two words", "two  words"])
            else:
                t = rows[-3][2]
            rows.append((n, seq, t))
    h = table(spark, [(t,) for t in history], "content string").withColumns({"h": F.lit(1), "t": F.lit(1)})
    b = table(spark, rows, "batch_no int, seq long, content string").withColumns({"h": F.lit(1), "t": F.lit(1), "s": F.lit(1)})
    want = brute_cases(history, rows, 0.5, 3)
    assert everything(rows_without_new_content(h, b, threshold=0.5, width=3)) == want
    assert rows_without_new_content(h, b.limit(0)).collect() == []
    index = HistoryIndex(spark, threshold=0.5, width=3)
    index.create(h.limit(0))
    first = [r for r in rows if r[0] == 1]
    one = table(spark, first, "batch_no int, seq long, content string")
    want = brute_cases([], first, 0.5, 3)
    assert everything(index.add_batch(one, 1)) == want
    assert everything(index.add_batch(one, 1)) == want  # a repeated run gives the same
    edges = table(
        spark,
        [(1, 2, False), (2, 3, False), (3, 4, False), (9, 6, True), (6, 7, False), (5, 7, False), (2, 8, False)],
        "a long, b long, old boolean",
    )
    assert everything(index._settle(edges)) == [(2,), (4,), (6,), (7,)]
    index = HistoryIndex(spark, index.folder, threshold=0.5, width=3).open()  # as a later session does
    again = everything(index.add_batch(one, 2))
    assert again == sorted((s,) for _, s, t in first if shingle_set(t, 3))
    index.drop()


def test_history_takes_successive_batches_together(spark, monkeypatch):
    rng = random.Random(12)
    base = [prose(rng, 60, 5000) for _ in range(4)]
    texts = [edited(rng, base[i % 4], 2) if i % 3 else prose(rng, 60, 5000) for i in range(18)]
    texts += [texts[0], texts[3]]
    calls = []
    add = HistoryIndex.add_batch
    monkeypatch.setattr(HistoryIndex, "add_batch", lambda self, rows, batch, *a, **k: calls.append(batch) or add(self, rows, batch, *a, **k))

    def found(numbers):
        calls.clear()
        rows = [(n, seq, t) for seq, (n, t) in enumerate(zip(numbers, texts), 1)]
        b = table(spark, rows, "batch_no int, seq long, content string")
        assert everything(rows_without_new_content(table(spark, [(base[0],)], "content string"), b, threshold=0.5, width=3)) == brute_cases([base[0]], rows, 0.5, 3)
        return len(calls)

    assert found([1 + i // 5 for i in range(20)]) == 1  # one pass over the history for four batches
    assert found([2 - i // 10 for i in range(20)]) == 2  # the later batch has the smaller sequences
    monkeypatch.setattr("larkspur.llm.history.BLOCK", 10)
    assert found([1 + i // 5 for i in range(20)]) == 2  # no more rows than a block


def test_history_shuffles_the_tokens_of_a_batch_once(spark, monkeypatch):
    rng = random.Random(13)
    texts = [prose(rng, 60, 5000) for _ in range(8)]
    plans = []

    def recorded(df):
        done = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return done

    monkeypatch.setattr("larkspur.llm.history.cut", recorded)
    index = HistoryIndex(spark, threshold=0.5, width=3)
    index.create(table(spark, [(t,) for t in texts[:4]], "content string"))
    rows = [(i, t) for i, t in enumerate([edited(rng, texts[0], 1), texts[5], edited(rng, texts[5], 1), texts[6]], 1)]
    assert everything(index.add_batch(table(spark, rows, "seq long, content string"), 1)) == [(1,), (3,)]
    probe = [p for p in plans if index.postings.table in p]
    assert len(probe) == 1
    made = [x for x in probe[0].splitlines() if "Exchange hashpartitioning(token" in x and "ReusedExchange" not in x]
    assert len(made) == 1
    index.drop()


# --- problem 6 -----------------------------------------------------------------------------------

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="needs the vocabulary file")


@pytest.fixture(scope="session")
def reference_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@needs_vocabulary
@LAX
@given(texts=st.lists(st.one_of(TEXT, NASTY, st.none()), max_size=6))
def test_encoding_property(reference_encoding, texts):
    ids, to = vocabulary(VOCABULARY).encode(pa.array(texts, pa.string()))
    got = [ids[a:b].tolist() for a, b in zip(to[:-1], to[1:])]
    assert got == [reference_encoding.encode_ordinary(t) if t else [] for t in texts]


@needs_vocabulary
def test_encoding(spark, reference_encoding):
    rng = random.Random(4)
    letters = "".join(rng.choice("abcdefgh") for _ in range(LONG * 6))
    texts = [None, "", "  ", "don't 'tis 's  x", letters, "a" * (LONG + 1), "日本語" * 900, "\U0001f469‍\U0001f527" * 50, "<|endoftext|>", "x " * 30000, "x " * 30000]
    df = table(spark, list(enumerate(texts)), "doc_id long, text string").withColumns({"ids": F.lit(1), "k": F.lit(1)})
    got = {r.doc_id: r.ids for r in encode_corpus(df).collect()}
    assert got == {i: reference_encoding.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert encode_corpus(df).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
    assert encode_corpus(df.limit(0)).collect() == []


# --- problem 7 -----------------------------------------------------------------------------------


@needs_vocabulary
@pytest.mark.parametrize("shard,capacity", [(4096, 2048), (40, 100)])
def test_packing(spark, shard, capacity):
    rng = random.Random(6)
    texts = [prose(rng, int(rng.paretovariate(0.9) * 8) % 3000) for _ in range(150)] + [None, "", " ", "x " * 9000, "same words here", "same words here"]
    df = table(spark, list(enumerate(texts)), "doc_id long, text string").withColumns({"k": F.lit(1), "s": F.lit(1), "container": F.lit(1)})
    sizes = {r.doc_id: len(r.ids) for r in encode_corpus(df).collect()}
    rows = pack(df, capacity=capacity, shard=shard).collect()
    filled, pieces = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        filled[r.container] += r.n_tokens
        pieces[r.doc_id].append((r.piece_no, r.token_start, r.n_tokens))
    assert max(filled.values()) <= capacity
    for i, n in sizes.items():
        want = [(j, j * capacity, min(capacity, n - j * capacity)) for j in range(math.ceil(n / capacity))]
        assert sorted(pieces.get(i, [])) == want
    assert len(filled) <= math.ceil(sum(sizes.values()) / capacity) + 2 * math.ceil(len(texts) / shard)
    assert sorted(map(tuple, rows)) == everything(pack(df, capacity=capacity, shard=shard))
    assert pack(df.limit(0)).collect() == []


# --- problem 8 -----------------------------------------------------------------------------------

VARIANTS = [
    "The cache keeps the office café open.",
    "Тhe cаche keeps the office café open.",
    "The cache keeps the oﬃce café open.",
    "Ｔｈｅ cache keeps the office café open．",
    "The ca​che keeps the office ca­fé open.",
    "the cache keeps the office café open.",
    "The cache keeps the office cafe open.",
    "The cache  keeps the office café open.",
    "The cache keeps the office² café open.",
    "The cache keeps the office2 café open.",
]


def test_lookalikes(spark):
    texts = VARIANTS + [VARIANTS[0], "Мария ест кашу", "Мария ест кaшу", "q̣̇x", "q̣̇x", "", None, " ", " ", "한국", "한국", "ｶﾞ", "ガ", "x" * 50000, "х" + "x" * 49999, "👩‍🔧 ok"]
    df = table(spark, list(enumerate(texts)), "doc_id long, text string").withColumns({"k": F.lit(1), "t": F.lit(1), "look_a": F.lit(1)})
    want = sorted(
        (i, j)
        for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2)
        if a and b and a.strip() and b.strip() and a != b and look(a) == look(b)
    )
    assert everything(V.lookalike_pairs(df)) == want and (0, 1) in want and (0, 5) not in want
    assert V.lookalike_pairs(df.limit(0)).collect() == []


def test_canonical(spark, monkeypatch):
    words = ["Мария ест кaшу", "Мария ест кашу", "ѕсrарs zеrо", "scraps zero", "сор", "сосна сор", "Сосe", "Νέα", "Nέα", "gя жaба", "gя жаба", "kadın", "kadin", "ոսս", "ո", "ӏо"]
    texts = VARIANTS[:5] + words + [None, "", "plain"]
    df = table(spark, list(enumerate(texts)), "doc_id long, text string").withColumn("k", F.lit(1))
    got = {r.doc_id: r.canonical for r in V.canonical_text(df).collect()}
    assert {got[i] for i in range(5)} == {VARIANTS[0]}
    form = {t: got[i] for i, t in enumerate(texts)}
    assert form["Мария ест кaшу"] == "Мария ест кашу" == form["Мария ест кашу"]
    assert form["ѕсrарs zеrо"] == "scraps zero"
    assert form["сосна сор"] == "сосна сор"  # the vocabulary knows only the Cyrillic word
    assert form["Nέα"] == form["Νέα"] == ud.normalize("NFC", "Νέα") and form["gя жaба"] == form["gя жаба"] and form["kadın"] == "kadin"
    assert form["Сосe"] == "Coce"  # of a class the vocabulary does not know
    assert form[None] is None and form[""] == "" and form["plain"] == "plain"
    for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2):  # equal forms are equal looks
        if a and b:
            assert (got[i] == got[j]) == (look(a) == look(b)), (a, b)
    classes = {r.doc_id: r.look for r in V.lookalike_classes(df).collect()}
    assert len({classes[i] for i in range(5)}) == 1 and len(classes) == len(texts) - 2
    nothing = table(spark, [], "k long, h array<long>, script array<int>")
    before = set(everything(V.lookalike_pairs(df)))
    monkeypatch.setattr(V, "approved_repairs", lambda *_: nothing)
    assert set(everything(V.lookalike_pairs(df))) < before  # the repair decides rows


def test_lookalikes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "PER_BLOCK", 3)
    texts = ["cache"] * 10 + ["саche"] * 7 + ["ｃache"] * 2
    df = table(spark, list(enumerate(texts)), "doc_id long, text string")
    assert everything(V.lookalike_pairs(df)) == sorted((i, j) for i in range(19) for j in range(i + 1, 19) if texts[i] != texts[j])


@LAX
@given(st.lists(st.one_of(TEXT, st.text(alphabet="aаeеéọ́ﬁＡ ​　한ᄒ", max_size=20)), max_size=6))
def test_fold_is_stable(texts):
    once = K.strings_from_code_points(*V.fold(*K.code_points(pa.array(texts, pa.string()))))
    twice = K.strings_from_code_points(*V.fold(*K.code_points(pa.array(once, pa.string()))))
    assert once == twice
