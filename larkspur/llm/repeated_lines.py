"""Lines repeated across one site's documents (problem 2).

Method: content-defined chunking.  Each text is reduced to comparable characters (white space runs
as one blank, lower case) and cut where a rolling hash over the last `WINDOW` characters meets a
fixed pattern.  Since the result is asked by line, a line's end also closes a chunk and no window
reaches over it; so equal lines give equal chunks whatever surrounds them, and a chunk knows whether it
is a whole line.  The distinct documents of each (site, chunk) are counted; a chunk that is a whole line
decides it, a line of several chunks is a candidate when all of them are repeated, and candidates are counted
once more as whole lines.  Keys have 128 bits, so two different lines share one with probability 1e-20
for a billion lines; texts are not compared again.

One pass over the texts gives every document's lines and chunks as one row of keys, written to the shared
folder; everything after it is counting and joining of keys in the JVM.

Shuffles: the texts once, to drop repeats of an id; one partially aggregated count by chunk, and a
semi-join of the chunks with the repeated ones; AQE splits a chunk that a large part of all documents carries.

Defined results: rows of one id count once; a url that is null or not http(s) has no site and its
lines are never removed; blank lines are never cases; null or empty content has no lines; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import cut as stored

WINDOW = 16
AVERAGE = 256
_CHUNK = 1 << 22
_FOLD: list[np.ndarray] = []


def site_of(url: Column) -> Column:
    """Host of an http(s) url in lower case, without user, port and leading `www.`; else null."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def fold_case() -> np.ndarray:
    """Lower-case form of every code point, where it is one code point."""
    if not _FOLD:
        t = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000:
                low = chr(c).lower()
                if len(low) == 1:
                    t[c] = ord(low)
        t[0x130] = ord("i")
        _FOLD.append(t)
    return _FOLD[0]


def comparable_lines(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Non-blank lines of all texts: (characters, line starts, line ends, text of each line, line number)."""
    cps, off = K.code_points(col)
    n_texts = len(off) - 1
    space = K.char_classes()[cps] == K.SPACE
    newline = cps == 10
    solid = np.flatnonzero(~space)
    breaks = np.concatenate([[0], np.cumsum(newline)])
    text = np.searchsorted(off, solid, "right") - 1
    line = breaks[solid] - breaks[off[text]]
    differs = np.ones(len(solid), bool)
    differs[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
    gap = np.zeros(len(solid), np.int64)
    gap[1:] = (np.diff(solid) > 1) & ~differs[1:]
    place = np.arange(len(solid)) + np.cumsum(gap)
    chars = np.full(len(solid) + int(gap.sum()), 32, np.uint32)
    chars[place] = fold_case()[cps[solid]]
    heads = np.flatnonzero(differs)
    starts = place[heads]
    ends = np.append(starts[1:], len(chars)) if len(starts) else starts
    return chars, starts, ends, text[heads] if n_texts else text, line[heads] + 1


def chunk_borders(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content-defined chunks: (chunk starts, chunk ends, line of each chunk)."""
    n = len(chars)
    cut = np.zeros(n + 1, bool)
    if n > WINDOW:
        tail = np.arange(WINDOW, n + 1)
        rolling = K.SegmentHash(chars, 5)(tail - WINDOW, tail)
        hit = tail[(rolling % np.uint64(AVERAGE)) == 0]
        inside = starts[np.searchsorted(starts, hit - 1, "right") - 1]
        cut[hit[hit - WINDOW >= inside]] = True
    cut[starts] = True
    cut[n] = False
    first = np.flatnonzero(cut)
    last = np.append(first[1:], n) if len(first) else first
    return first, last, np.searchsorted(starts, first, "right") - 1


_ROW = "no array<int>, n_chunks array<int>, key_a array<long>, key_b array<long>, line array<int>, chunk_a array<long>, chunk_b array<long>, fresh array<boolean>"


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns k, site, content -> k and the keys of the document's lines and chunks; keys depend on the site.

    no, n_chunks, key_a, key_b: one entry a line; line (which of the lines), chunk_a, chunk_b, fresh (the
    first such chunk of the document): one entry a chunk.
    """
    for batch in batches:
        _, byte_off = K.string_buffer(batch.column(2))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(byte_off, byte_off[lo] + _CHUNK, "right")) - 1)
            part = batch.slice(lo, hi - lo)
            lo = hi
            chars, s, e, text, number = comparable_lines(part.column(2))
            if not len(s):
                continue
            raw, off = K.string_buffer(part.column(1))
            a, b, line = chunk_borders(chars, s, e)
            n_chunks = np.bincount(line, minlength=len(s))
            whole = (n_chunks[line] == 1).astype(np.uint64)
            keys = []
            for seed in (9, 10):
                site = K.SegmentHash(raw, seed)(off[:-1], off[1:])[text]
                h = K.SegmentHash(chars, seed)
                keys += [K.mix64(h(s, e) * np.uint64(3) + site), K.mix64(h(a, b) * np.uint64(5) + site[line] + whole)]
            chunk = keys[1]
            order = np.lexsort((chunk, text[line]))
            fresh = np.ones(len(chunk), bool)
            t, c = text[line][order], chunk[order]
            fresh[order[1:]] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
            rows = np.unique(text)
            by_line, by_chunk = (np.searchsorted(x, np.append(rows, part.num_rows)).astype(np.int32) for x in (text, text[line]))
            lists = lambda to, x: pa.ListArray.from_arrays(pa.array(to), pa.array(x))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(rows)),
                    *(lists(by_line, x) for x in (number.astype(np.int32), n_chunks.astype(np.int32), keys[0].view(np.int64), keys[2].view(np.int64))),
                    lists(by_chunk, (line - by_line[np.searchsorted(rows, text[line])]).astype(np.int32)),
                    *(lists(by_chunk, x) for x in (chunk.view(np.int64), keys[3].view(np.int64), fresh)),
                ],
                ["k", "no", "n_chunks", "key_a", "key_b", "line", "chunk_a", "chunk_b", "fresh"],
            )


def repeated_lines(
    docs: DataFrame, key: str = "id", url: str = "url", text: str = "content", min_docs: int = 8
) -> DataFrame:
    """(key, line_no) of the non-blank lines that at least `min_docs` documents of the site carry."""
    src = (
        docs.select(F.col(key).alias("k"), site_of(F.col(url)).alias("site"), F.col(text).alias("content"))
        .where("site is not null and content is not null")
        .dropDuplicates(["k"])
    )
    kind = src.schema["k"].dataType.simpleString()
    rows = stored(src.mapInArrow(_chunk_rows, f"k {kind}, {_ROW}"))
    chunk = ["chunk_a", "chunk_b"]
    first = F.filter(F.arrays_zip("chunk_a", "chunk_b", "fresh"), lambda c: c["fresh"])
    hot = rows.select(F.inline(first)).groupBy(*chunk).count().where(F.col("count") >= min_docs).select(*chunk)
    every = rows.select("k", "no", "n_chunks", "key_a", "key_b", F.inline(F.arrays_zip("line", *chunk)))
    at = lambda c: F.col(c)[F.col("line")].alias(c)
    held = every.select("k", at("no"), at("n_chunks"), at("key_a"), at("key_b"), *chunk).join(hot, chunk, "left_semi")
    single = held.where("n_chunks = 1").select("k", "no")
    line = ["key_a", "key_b"]
    several = held.where("n_chunks > 1").groupBy("k", "no", "n_chunks", *line).count()
    several = several.where("count = n_chunks").select("k", "no", *line)
    sure = several.select(*line, "k").distinct().groupBy(*line).count().where(F.col("count") >= min_docs)
    several = several.join(sure.select(*line), line, "left_semi").select("k", "no")
    return single.unionByName(several).select(F.col("k").alias(key), F.col("no").alias("line_no"))


def without_repeated_lines(
    docs: DataFrame, key: str = "id", url: str = "url", text: str = "content", min_docs: int = 8
) -> DataFrame:
    """(key, content) of each id once, without its repeated lines; the other lines stay as they are."""
    once = docs.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(text).alias("t")).dropDuplicates(["k"])
    cut = (
        repeated_lines(once, "k", "u", "t", min_docs).groupBy("k").agg(F.collect_list("line_no").alias("cut"))
    )  # a list is no longer than its document
    lines = F.split("t", "\n")
    left = F.filter(
        F.transform(lines, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("n"))),
        lambda s: ~F.array_contains(F.col("cut"), s["n"]),
    )
    kept = F.array_join(F.transform(left, lambda s: s["x"]), "\n")
    return once.join(cut, "k", "left").select(
        F.col("k").alias(key), F.when(F.col("cut").isNull(), F.col("t")).otherwise(kept).alias("content")
    )
