"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 6).

Method: contiguous rank array.  Each distinct word of a batch holds its part ids and the ranks of
its adjacent pairs in one contiguous row; the row's minimum is found by a scan, the boundary there
is deleted, and the two neighbouring ranks are refreshed, until no adjacent pair is in the
vocabulary.  Rows of similar length are stacked into a matrix, so one numpy instruction advances
many words by one merge.  Words beyond `LONG` bytes take a heap over linked parts instead, which
gives the same merges without a quadratic scan.

The operator is map-only: no shuffle, no collect; only the vocabulary's path travels to the tasks.

Defined results: null and empty texts give an empty list; blank text is encoded like any other;
strings of special tokens in a text are ordinary text; extra columns are ignored; an empty table
gives an empty table; repeated rows and ties are encoded row by row, one output row each.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

VOCABULARY = os.environ.get("LARKSPUR_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
LONG = 512
_NONE = np.int32(2**31 - 1)
_WIDTHS = [2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 48, 64, 128, 256, LONG]
_CHUNK = 1 << 22


class RankVocabulary:
    """Byte-level BPE ranks read from a rank file (one base64 token and its rank per line)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ranks = self.ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, vals = [], []
        get = ranks.get
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a = get(token[:cut])
                if a is not None and (b := get(token[cut:])) is not None:
                    keys.append(a << 32 | b)
                    vals.append(rank)
        k, v = np.array(keys, np.int64), np.array(vals, np.int32)
        order = np.argsort(k)
        self._keys, self._vals = k[order], v[order]
        self.pair = dict(zip(keys, vals))
        left = np.repeat(self.byte_id, 256).astype(np.int64)
        self._bytes = self._search(left, np.tile(self.byte_id, 256).astype(np.int64)).reshape(256, 256)

    def _search(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (left >= 0) & (right >= 0), self._vals[at], _NONE)

    # -- words ------------------------------------------------------------------------------

    def encode_words(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, number of ids of each word)."""
        n = end - start
        count = np.ones(len(n), np.int64)
        pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        one = np.flatnonzero(n == 1)
        pieces.append((one, count[one], self.byte_id[raw[start[one]]]))
        low = 1
        for width in _WIDTHS:
            rows = np.flatnonzero((n > low) & (n <= width))
            low = width
            for part in np.array_split(rows, max(1, len(rows) * width // 2_000_000)):
                if len(part):
                    pieces.append((part, *self._merge(raw, start[part], n[part], width)))
        for i in np.flatnonzero(n > LONG):
            ids = np.array(self._merge_long(raw[start[i] : end[i]]), np.int32)
            pieces.append((np.array([i]), np.array([len(ids)]), ids))
        for rows, c, _ in pieces:
            count[rows] = c
        to = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(to[-1], np.int32)
        for rows, c, ids in pieces:
            out[K.ranges(to[rows], c)] = ids
        return out, count

    def _merge(self, raw: np.ndarray, start: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        cols = np.arange(width)
        inside = cols < n[:, None]
        at = np.where(inside, start[:, None] + cols, start[:, None])
        b = raw[at]
        parts = np.where(inside, self.byte_id[b], np.int32(-1))
        rank = np.full((len(n), width), _NONE, np.int32)
        rank[:, :-1] = np.where(inside[:, 1:], self._bytes[b[:, :-1], b[:, 1:]], _NONE)
        live = np.arange(len(n))
        done = np.full((len(n), width), -1, np.int32)
        while len(live):
            j = rank.argmin(axis=1)
            r = np.arange(len(live))
            best = rank[r, j]
            stop = best == _NONE
            if stop.any():
                done[live[stop], : parts.shape[1]] = parts[stop]
                go = ~stop
                live, parts, rank, j, best = live[go], parts[go], rank[go], j[go], best[go]
                if not len(live):
                    break
                r = np.arange(len(live))
            w = parts.shape[1]
            c = np.arange(w - 1)
            after = c > j[:, None]
            parts[r, j] = best
            parts = np.where(after, parts[:, 1:], parts[:, :-1])  # delete boundary j+1
            rank = np.where(after | (c == j[:, None]), rank[:, 1:], rank[:, :-1])
            here = np.where(j < w - 1, j, 0)
            right = np.where(j + 1 < w - 1, parts[r, np.minimum(j + 1, w - 2)], -1)
            rank[r, here] = self._search(parts[r, here].astype(np.int64), right.astype(np.int64))
            has_left = j > 0
            if has_left.any():
                q, k = r[has_left], j[has_left]
                rank[q, k - 1] = self._search(parts[q, k - 1].astype(np.int64), parts[q, k].astype(np.int64))
        keep = done >= 0
        return keep.sum(axis=1), done[keep]

    def _merge_long(self, raw: np.ndarray) -> list[int]:
        ids = self.byte_id[raw].tolist()
        n = len(ids)
        nxt, prv, pair = list(range(1, n + 1)), list(range(-1, n - 1)), self.pair
        heap = [(pair[k], i, ids[i], ids[i + 1]) for i in range(n - 1) if (k := ids[i] << 32 | ids[i + 1]) in pair]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for p, q in ((prv[i], i), (i, nxt[i])):
                if p >= 0 and q < n and (k := ids[p] << 32 | ids[q]) in pair:
                    heapq.heappush(heap, (pair[k], p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    # -- texts ------------------------------------------------------------------------------

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, borders of the texts); nulls and empty texts have none."""
        ids, borders = [], [np.zeros(1, np.int64)]
        _, off = K.string_buffer(col)
        lo = base = 0
        while lo < len(col):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + _CHUNK, "right")) - 1)
            part, to = self._encode_chunk(col.slice(lo, hi - lo))
            ids.append(part)
            borders.append(to[1:] + base)
            base += len(part)
            lo = hi
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), np.concatenate(borders)

    def _encode_chunk(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cps, off = K.code_points(col)
        if len(cps) == 0:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        starts = word_starts(cps, off)
        wide = 1 + (cps > 0x7F).astype(np.int64) + (cps > 0x7FF) + (cps > 0xFFFF)
        at = np.concatenate([[0], np.cumsum(wide)])
        raw = np.frombuffer(cps.tobytes().decode("utf-32-le", "replace").encode("utf-8"), np.uint8)
        s = at[starts]
        e = np.append(s[1:], at[-1])
        codes, rep = K.distinct_segments(raw, s, e)
        ids, count = self.encode_words(raw, s[rep], e[rep])
        first = np.concatenate([[0], np.cumsum(count)])[:-1]
        per_word = count[codes]
        upto = np.concatenate([[0], np.cumsum(per_word)])
        return ids[K.ranges(first[codes], per_word)], upto[np.searchsorted(starts, off)]


def word_starts(cps: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the words into which the vocabulary's pattern splits the texts.

    The pattern: contractions at an apostrophe; an optional blank with a run of letters, of numbers
    or of other signs; white space, whose last character is left to the next word.
    """
    n = len(cps)
    c = K.char_classes()[cps]
    first = np.zeros(n + 1, bool)
    first[off] = True
    space = c == K.SPACE
    prev_space = np.zeros(n, bool)
    prev_space[1:] = space[:-1]
    prev_blank = np.zeros(n, bool)
    prev_blank[1:] = cps[:-1] == 32
    differs = np.ones(n, bool)
    differs[1:] = c[1:] != c[:-1]
    head = first[:n]
    next_solid = np.zeros(n, bool)
    next_solid[:-1] = ~space[1:]
    next_solid &= ~first[1:]
    start = np.where(space, head | ~prev_space | next_solid, head | (differs & ~prev_blank))
    # contractions: an apostrophe where a match can begin, with s t m d, re, ve or ll behind it
    q = np.flatnonzero(cps == 39)
    q = q[start[q]]
    if len(q):
        pad = np.concatenate([cps, np.zeros(2, cps.dtype)])
        inside1 = ~first[np.minimum(q + 1, n)]
        inside2 = inside1 & ~first[np.minimum(q + 2, n)]
        a, b = pad[q + 1], pad[q + 2]
        short = inside1 & np.isin(a, [ord(x) for x in "stmd"])
        pair = inside2 & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        alone = c[np.minimum(q + 1, n - 1)] == K.LETTER
        short, pair = short & alone, pair & alone
        for hit, size in ((short, 2), (pair, 3)):
            at = q[hit]
            start[at + 1] = False
            end = at + size
            end = end[end < n]
            end = end[~space[end]]
            start[end] = True
    return np.flatnonzero(start)


_LOADED: dict[str, RankVocabulary] = {}


def vocabulary(path: str) -> RankVocabulary:
    """The vocabulary of a rank file, read once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = RankVocabulary(path)
    return _LOADED[path]


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """One row (key, ids ARRAY<INT>) for each row of `docs`."""
    src = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = src.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            ids, to = vocab.encode(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(ids))], ["k", "ids"]
            )

    return src.mapInArrow(run, f"k {kind}, ids array<int>").select(F.col("k").alias(key), "ids")
