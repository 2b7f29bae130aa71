"""Filling fixed-capacity containers with texts (problem 7).

Method: lexical retrieval packing.  Documents are hashed into shards of about `SHARD` documents.
Each shard builds a BM25 inverted index over the token ids of its items; the largest unused item
seeds a container, and its unused neighbours fill the window greedily in order of their BM25 score
while they fit.  When little room is left, the one or two unused items that fill it best close the
container, so that the windows end nearly full.

An item is a text, or the last piece of a text longer than the capacity; the pieces before it fill
containers of their own.  One shuffle, of the texts by key; a shard is one task of bounded memory,
and each shard leaves at most a few containers unfilled.

Defined results: texts without tokens (null, empty) are left out; a text that exceeds the capacity
is split every `capacity` tokens; repeated rows are packed row by row; ties go to the smaller key;
extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tokenizer import VOCABULARY, vocabulary

SHARD = 4096
K1, B = 1.5, 0.75
_CLOSE = 0.25


class ShardIndex:
    """BM25 inverted index over the items of one shard; items are ragged rows of token ids."""

    def __init__(self, ids: np.ndarray, start: np.ndarray, size: np.ndarray):
        n = len(size)
        item = np.repeat(np.arange(n, dtype=np.int64), size)
        at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(len(item))
        pair, tf = np.unique(item << 32 | ids[at].astype(np.int64), return_counts=True)
        item, term = pair >> 32, pair & 0xFFFFFFFF
        self._terms, code, df = np.unique(term, return_inverse=True, return_counts=True)
        idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0.0)
        norm = K1 * (1 - B + B * size / max(size.mean(), 1.0))
        weight = idf[code] * tf * (K1 + 1) / (tf + norm[item])
        useful = weight > 0
        item, code, weight = item[useful], code[useful], weight[useful]
        order = np.argsort(code, kind="stable")
        self._post_item, self._post_weight = item[order], weight[order].astype(np.float32)
        self._post = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(df)))])
        self._own = np.concatenate([[0], np.cumsum(np.bincount(item, minlength=n))])
        self._own_code = code
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of every item for the terms of the seed."""
        codes = self._own_code[self._own[seed] : self._own[seed + 1]]
        lo, hi = self._post[codes], self._post[codes + 1]
        if not len(codes):
            return np.zeros(self.n, np.float32)
        idx = K.ranges(lo, hi - lo)
        return np.bincount(self._post_item[idx], self._post_weight[idx], self.n)


def _best_close(sizes: np.ndarray, items: np.ndarray, room: int) -> list[int]:
    """The one or two of `items` (ascending by size) that leave the least room."""
    one = int(np.searchsorted(sizes, room, "right")) - 1
    if one < 0:
        return []
    best, picks = room - int(sizes[one]), [int(items[one])]
    if best and one > 0:
        a = np.arange(one + 1)
        b = np.minimum(np.searchsorted(sizes, room - sizes[a], "right") - 1, a - 1)
        ok = b >= 0
        if ok.any():
            left = np.where(ok, room - sizes[a] - sizes[np.maximum(b, 0)], room)
            k = int(left.argmin())
            if left[k] < best:
                picks = [int(items[k]), int(items[b[k]])]
    return picks


def pack_shard(ids: np.ndarray, start: np.ndarray, size: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item of a shard; items are no larger than the capacity."""
    n = len(size)
    where = np.full(n, -1, np.int64)
    index = ShardIndex(ids, start, size)
    unused = np.ones(n, bool)
    order = np.argsort(size, kind="stable")
    now = 0
    for seed in order[::-1].tolist():
        if not unused[seed]:
            continue
        unused[seed] = False
        where[seed] = now
        room = capacity - int(size[seed])
        if room > 0:
            if room > capacity * _CLOSE:
                score = index.scores(seed)
                near = np.flatnonzero(unused & (score > 0) & (size <= room))
                for i in near[np.argsort(-score[near], kind="stable")].tolist():
                    if unused[i] and size[i] <= room and score[i] > 0:
                        unused[i] = False
                        where[i] = now
                        room -= int(size[i])
                        if room <= capacity * _CLOSE:
                            break
            while room > 0:
                pool = order[unused[order]]
                pool = pool[: np.searchsorted(size[pool], room, "right")]
                if not len(pool):
                    break
                if room > capacity * _CLOSE:
                    picks = [int(pool[-1])]
                else:
                    picks = _best_close(size[pool], pool, room)
                for i in picks:
                    unused[i] = False
                    where[i] = now
                    room -= int(size[i])
        now += 1
    return where


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    path: str = VOCABULARY,
    shard: int = SHARD,
) -> DataFrame:
    """(container, key, piece_no, token_start, n_tokens), one row for each item or piece.

    container: shard number * 2**32 + number within the shard.
    """
    src = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("t is not null and t <> ''")
    kind = src.schema["k"].dataType.simpleString()
    shards = max(1, -(-docs.count() // shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        parts: dict[int, list[pa.RecordBatch]] = {}
        for b in batches:
            numbers = b.column(2).to_numpy()
            for s in np.unique(numbers).tolist():
                parts.setdefault(s, []).append(b.filter(pa.array(numbers == s)))
        for s, held in parts.items():
            table = pa.Table.from_batches(held).combine_chunks()
            order = pa.compute.sort_indices(table.select(["k", "t"]), [("k", "ascending"), ("t", "ascending")])
            table = table.take(order)
            ids, to = vocab.encode(table.column("t").combine_chunks())
            size = np.diff(to)
            n_pieces = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), n_pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            at = piece * capacity
            n = np.minimum(size[doc] - at, capacity)
            item = np.flatnonzero(n < capacity)
            full = np.flatnonzero(n == capacity)
            where = np.empty(len(doc), np.int64)
            where[item] = pack_shard(ids, to[doc[item]] + at[item], n[item], capacity) if len(item) else 0
            where[full] = (where[item].max() + 1 if len(item) else 0) + np.arange(len(full))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((np.int64(s) << 32) + where),
                    table.column("k").combine_chunks().take(pa.array(doc)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(at.astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                ],
                ["container", "k", "piece_no", "token_start", "n_tokens"],
            )

    number = F.pmod(F.xxhash64("k"), F.lit(shards)).cast("int").alias("s")
    out = src.select("k", "t", number).repartitionById(shards, F.col("s")).mapInArrow(  # a shard is a task
        run, f"container long, k {kind}, piece_no int, token_start int, n_tokens int"
    )
    return out.withColumnRenamed("k", key)
