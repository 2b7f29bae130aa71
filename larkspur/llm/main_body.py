"""Main body of web pages (problem 4).

Method: tree scoring.  `content` is text without tags, so the tree of a page is built from its lines:
lines are the paragraphs, runs of lines on one side of density 0.5 are blocks, and blocks between runs
of links are sections of the page.  A line's points are 1, one for each comma and up to three for its
length.  A block's points are those of its lines, discounted by its link density; it passes half of
them on to its section and a quarter to the page.  The container is the section that gathers most.  A
block is kept when its points a line reach `FLOOR` and its section is the container or a sibling, one
with `SIBLING` of its points.

Link density is not marked in text, so it is taken from structure and from counts over the collection:

* a line whose template is held by many pages is part of the pages' frame: density 1.  In a template
  numbers are 0 and uncommon words #, so "by Ada Byron, 3/4/2021" and its like are one;
* a path that ends with the page's own title: 1; a line that opens like many others ("Read also: ..."):
  0.95; a text cut off with an ellipsis, or separated labels: 0.9;
* list items, requests and rows of figures: 0.25; sentences, long lines and what a wrapped paragraph goes
  on with: 0;
* short lines without an end: 0.4 inside running text (headings, items), 0.8 elsewhere (titles of other pages);
* a repeated label directly between running text: 0.4, as a heading.

No wording is fixed.  Two counts come first: words held by `COMMON_SHARE` of the pages are common;
templates and openings held by `REPEAT_SHARE` of them are repeated.  Both lists go to the driver and are broadcast; their
sizes are bounded by the shares: no more than (words, or lines, of a page on average) / share entries,
whatever the number of pages.  Counts are over every page; each task sends a count of each distinct
entry.  Tables of few pages (under about 300) have few repeats, so less of their frame is found.

Defined results: rows of one id count once; null, empty and blank contents have no lines; a page
without any running text keeps its title and the short lines right below it; a null key counts as a key;
extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut

#: Lines longer than this are prose by their length alone.
LONG = 300
#: A word is common, a template or opening repeated, from this share of the pages (and this number of them) on.
COMMON_SHARE, REPEAT_SHARE, LEAST_PAGES = 0.002, 0.001, 6
#: Share of the container's points that makes another section its sibling.
SIBLING = 0.05
#: Points a line that keep a block.
FLOOR = 0.5

#: Distinct entries that a task holds before it sends their counts.
_HELD = 500_000
_WORDS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
_END = re.compile(r"[.!?…。:;»”\"')\]]$")
_PIECES = re.compile(r"\s*[|/·»>›•]\s*")
_STEP = re.compile(r" [/·»>›|] ")
_LEAD = re.compile(r"^(\W*(?:\w+[ ’']?){0,3}\s?(?:[:–—]|>>|»))\s")
_CUT_OFF = re.compile(r"…(?:\W*\w+){0,3}\W*$")
_BULLET = re.compile(r"(?:[*•–-]|\d+[.)])\s+\S|[A-Z]{3,6} /\S|[^\w]+$")


def template(line: str, common: frozenset[str]) -> str:
    """A line's words with numbers as 0 and runs of uncommon words as #."""
    out: list[str] = []
    for w in _WORDS.findall(line):
        w = "0" if w.isdigit() else w if w in common or not w[0].isalpha() else "#"
        if not (w == "#" and out and out[-1] == "#"):
            out.append(w)
    return " ".join(out)


def lead(line: str) -> str:
    """The few words before a line's first colon or dash; empty without."""
    m = _LEAD.match(line)
    return m.group(1) if m else ""


def _is_data(line: str) -> bool:
    """List items, requests, separators and rows of a table with figures."""
    if _BULLET.match(line):
        return True
    cells = line.split(" | ")
    return len(cells) > 2 and sum(any(c.isdigit() for c in x) for x in cells) > 1


@dataclass(frozen=True)
class Frame:
    """What the pages of a collection share."""

    common: frozenset[str] = frozenset()
    templates: frozenset[str] = frozenset()
    leads: frozenset[str] = frozenset()


def densities(flat: list[str], low: list[str], solid: list[int], top: int, paths: set[int], frame: Frame) -> list[float]:
    """Link density of every non-blank line; top: the title's line."""
    out: list[float] = []
    label: list[bool] = []
    for i in solid:
        x, y = flat[i], low[i]
        sentence = bool(_END.search(x)) and y.count(" ") > 2
        before = flat[i - 1] if i else ""
        repeated = False
        if i == top or len(x) > LONG:
            d = 0.0
        elif i in paths:
            d = 1.0
        elif _is_data(x):
            d = 0.25
        elif len(before) > 40 and not _END.search(before) and i - 1 != top and out[-1] == 0.0:
            d = 0.0  # a wrapped paragraph goes on
        elif template(y, frame.common) in frame.templates:
            d, repeated = 1.0, len(x) < 40 and x.replace(" ", "").isalpha() and x[1:] == y[1:]
        elif not sentence and lead(y) in frame.leads:
            d = 0.95
        elif _CUT_OFF.search(x):
            d = 0.9
        elif sentence or len(x) > 60:
            d = 0.0
        else:
            parts = _PIECES.split(x)
            d = 0.9 if len(parts) > 2 and all(p.count(" ") < 2 for p in parts) else 0.6
        out.append(d)
        label.append(repeated)
    n, k = len(out), 0
    while k < n:  # short lines inside running text are its headings and items, others are links
        end = k
        while end < n and out[end] == 0.6:
            end += 1
        if end > k:
            text_after = end < n and out[end] < 0.5
            inside = k > 0 and ((out[k - 1] < 0.5 and (end < n or solid[k - 1] == top)) or (k > 1 and label[k - 1] and out[k - 2] < 0.5 and text_after))
            opens = end == k + 1 and text_after and not any(d < 0.5 for d in out[:k])
            out[k:end] = [0.4 if inside or opens else 0.8] * (end - k)
        k = max(end, k + 1)
    for k in range(1, n - 1):
        if label[k] and out[k - 1] < 0.5 and out[k + 1] < 0.5:
            out[k] = 0.4
    return out


def kept_lines(flat: list[str], share: list[float], solid: list[int], top: int) -> list[bool]:
    """For each non-blank line: whether it lies in a good block of the container or of its siblings."""
    blocks: list[list[int]] = []
    for k, s in enumerate(share):
        if not k or (s >= 0.5) != (share[k - 1] >= 0.5) or top in (solid[k - 1], solid[k]):
            blocks.append([])
        blocks[-1].append(k)
    points, section, at = [], [], 0
    for b in blocks:
        size = [len(flat[solid[k]]) for k in b]
        density = sum(n * share[k] for n, k in zip(size, b)) / sum(size)
        points.append((1 - density) * sum(1 + flat[solid[k]].count(",") + min(n / 100, 3) for n, k in zip(size, b)))
        at += density >= 0.5 and len(b) > 1
        section.append(at)
    gathered: Counter[int] = Counter()
    for p, s in zip(points, section):
        gathered[s] += p / 2
    page = sum(points) / 4
    best = max(gathered.values(), default=0.0)
    out = [False] * len(share)
    for b, p, s in zip(blocks, points, section):
        title = solid[b[0]] == top
        good = p / len(b) >= FLOOR and gathered[s] >= SIBLING * max(best, page / len(blocks))
        for k in b:
            out[k] = title or (good and solid[k] >= top)
    return out


def body_mask(lines: list[str], title: str | None, frame: Frame) -> list[bool | None]:
    """For each line of a page: None if blank, True if main body, False if not."""
    flat = [" ".join(x.split()) for x in lines]
    low = [x.lower() for x in flat]
    head = " ".join((title or "").split()).lower()
    solid = [i for i, x in enumerate(flat) if x]
    known = {low[i] for i in solid} | ({head} if head else set())
    paths: dict[int, str] = {}
    for i in solid:
        for m in _STEP.finditer(low[i]):
            if low[i][m.end() :] in known and all(p.count(" ") < 3 for p in _PIECES.split(low[i][: m.start()])):
                paths[i] = low[i][m.end() :]
                break
    if not any(low[i] == head for i in solid):
        head = next(iter(paths.values()), head)  # the title is missing: a path names it
    top = next((i for i in solid if head and low[i] == head), -1)
    kept = kept_lines(flat, densities(flat, low, solid, top, set(paths), frame), solid, top)
    out: list[bool | None] = [None] * len(lines)
    for k, i in enumerate(solid):
        out[i] = kept[k]
    return out


def not_main_body(docs: DataFrame, key: str = "id", title: str = "title", text: str = "content") -> DataFrame:
    """(key, line_no) of the non-blank lines that are not main body."""
    return _lines(docs, key, title, text).where("not body").select(key, "line_no")


def main_body(docs: DataFrame, key: str = "id", title: str = "title", text: str = "content") -> DataFrame:
    """(key, line_no, line) of the main body's lines, trimmed."""
    return _lines(docs, key, title, text).where("body").select(key, "line_no", "line")


def _short_lines(text: str) -> list[str]:
    return [y for x in text.split("\n") if (y := " ".join(x.split()).lower()) and len(y) <= LONG]


def _counted(once: DataFrame, kinds: Callable[[str], list[set[str]]], least: float) -> list[frozenset[str]]:
    """Entries of each kind that at least `least` pages hold; kinds: a page's entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[Counter[str]] = []
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for n, found in enumerate(kinds(text)):
                    if n == len(total):
                        total.append(Counter())
                    total[n].update(found)
            if sum(map(len, total)) > _HELD:
                yield from flushed(total)
                total = []
        yield from flushed(total)

    def flushed(total: list[Counter[str]]) -> Iterator[pa.RecordBatch]:
        for n, c in enumerate(total):
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(c), pa.int32()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["kind", "x", "n"])

    counts = once.select("content").mapInArrow(run, "kind int, x string, n long").groupBy("kind", "x").agg(F.sum("n").alias("n"))
    out: dict[int, set[str]] = {}
    for kind, x in counts.where(F.col("n") >= least).select("kind", "x").toLocalIterator():
        out.setdefault(kind, set()).add(x)
    return [frozenset(out.get(n, ())) for n in range(2)]


def frame_of(once: DataFrame) -> Frame:
    """What the pages share; once: (.., content), one row a page."""
    pages = once.count()
    common, _ = _counted(once, lambda t: [{w for x in _short_lines(t) for w in _WORDS.findall(x) if w[0].isalpha()}], max(LEAST_PAGES, COMMON_SHARE * pages))
    sent = once.sparkSession.sparkContext.broadcast(common)

    def entries(text: str) -> list[set[str]]:
        lines = _short_lines(text)
        return [{template(x, sent.value) for x in lines}, {y for x in lines if (y := lead(x))}]

    return Frame(common, *_counted(once, entries, max(LEAST_PAGES, REPEAT_SHARE * pages)))


def _lines(docs: DataFrame, key: str, title: str, text: str) -> DataFrame:
    once = cut(
        docs.select(F.col(key).alias("k"), F.col(title).cast("string").alias("title"), F.col(text).cast("string").alias("content"))
        .where("content is not null")
        .dropDuplicates(["k"])
    )
    kind = once.schema["k"].dataType.simpleString()
    sent = once.sparkSession.sparkContext.broadcast(frame_of(once))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                row, number, line, body = [], [], [], []
                for r, (t, c) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    lines = c.split("\n")
                    for n, (x, keep) in enumerate(zip(lines, body_mask(lines, t, frame)), 1):
                        if keep is not None:
                            row.append(r)
                            number.append(n)
                            line.append(x.strip())
                            body.append(keep)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.array(row, np.int64))),
                        pa.array(number, pa.int32()),
                        pa.array(line, pa.string()),
                        pa.array(body, pa.bool_()),
                    ],
                    ["k", "line_no", "line", "body"],
                )

    return once.mapInArrow(run, f"k {kind}, line_no int, line string, body boolean").withColumnRenamed("k", key)
