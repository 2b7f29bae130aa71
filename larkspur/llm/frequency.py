"""Frequency of every distinct term (problem 3).

Method: a global integer dictionary whose identifier space is cut into ranges.  A term belongs to
the range given by its hash; inside the range it gets the next free integer.  Each block of records
becomes, for each range, three parallel arrays (terms, occurrences, records holding the term); one
shuffle brings the arrays of a range together, where the terms are encoded by the range's part of
the dictionary and the count arrays are summed by identifier.

Only per-block sums are shuffled, never single tokens, so a term that fills a third of the
collection costs one entry a block.  A range is one task; its memory is its distinct terms plus a fixed
buffer, and the number of ranges follows the number of tokens, which is counted first.

Defined results: rows of one id count once (a null id is an id of its own); null and empty terms are
left out; null or empty token lists hold no term but their ids count among all ids; terms are
compared exactly as stored; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Tokens for an identifier range, and least number of ranges.
RANGE_TOKENS, LEAST_RANGES = 1 << 20, 16
_BLOCK = 1 << 18
_BUFFER = 1 << 20
_PIECE = 1 << 14


def _block_counts(values: pa.Array, row: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, their hashes, occurrences, records) of a block; row: the record of each value."""
    raw, off = K.string_buffer(values)
    start, end = off[:-1], off[1:]
    keep = end > start
    start, end, row = start[keep], end[keep], row[keep]
    codes, rep = K.distinct_segments(raw, start, end)
    n = len(rep)
    occurrences = np.bincount(codes, minlength=n)
    pairs = pd.unique(row * np.int64(max(n, 1)) + codes)
    records = np.bincount(pairs % max(n, 1), minlength=n) if n else occurrences
    terms = values.take(pa.array(np.flatnonzero(keep)[rep]))
    return terms, K.SegmentHash(raw, 77)(start[rep], end[rep]), occurrences, records


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Token lists of a batch in blocks of about `_BLOCK` tokens: (values, record of each value)."""
    lists = batch.column(0)
    lo = 0
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    while lo < len(lists):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + _BLOCK, "right")) - 1)
        part = lists.slice(lo, hi - lo)
        yield part.flatten(), np.repeat(np.arange(hi - lo), sizes[lo:hi])
        lo = hi


def count_terms(docs: DataFrame, key: str = "id", tokens: str = "tokens", ranges: int | None = None) -> DataFrame:
    """(term, term_id, occurrences, records) of every distinct term, one row each.

    ranges: number of identifier ranges; if None one for `RANGE_TOKENS` tokens, `LEAST_RANGES` at least.
    term_id: range number * 2**40 + place of the term in its range.
    """
    parts = ranges
    if parts is None:
        held = docs.agg(F.sum(F.size(F.coalesce(F.col(tokens), F.array()))).alias("n")).first()["n"] or 0
        parts = max(LEAST_RANGES, -(-held // RANGE_TOKENS))
    once = docs.select(F.col(key).alias("k"), F.col(tokens).alias("t")).dropDuplicates(["k"]).select("t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values, row in _blocks(batch):
                terms, h, occ, rec = _block_counts(values, row)
                where = (h % np.uint64(parts)).astype(np.int32)
                order = np.argsort(where, kind="stable")
                sizes = np.bincount(where, minlength=parts)
                used = np.flatnonzero(sizes)
                to = pa.array(np.concatenate([[0], np.cumsum(sizes[used])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used.astype(np.int32))]
                    + [pa.ListArray.from_arrays(to, c) for c in (terms.take(pa.array(order)), pa.array(occ[order]), pa.array(rec[order]))],
                    ["range", "terms", "occ", "rec"],
                )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def sum_up(of: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
            terms = pa.concat_arrays([x[0] for x in held[of]])
            raw, off = K.string_buffer(terms)
            codes, rep = K.distinct_segments(raw, off[:-1], off[1:])  # the range's part of the dictionary
            n = len(rep)
            occ, rec = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(occ, codes, np.concatenate([x[1] for x in held[of]]))
            np.add.at(rec, codes, np.concatenate([x[2] for x in held[of]]))
            held[of] = [(terms.take(pa.array(rep)), occ, rec)]
            return held[of][0]

        fresh = 0
        for batch in batches:
            for i, of in enumerate(batch.column(0).to_pylist()):
                a, b, c = (batch.column(j).slice(i, 1).flatten() for j in (1, 2, 3))
                held.setdefault(of, []).append((a, b.to_numpy(), c.to_numpy()))
                fresh += len(a)
            if fresh > _BUFFER:
                for of in held:
                    sum_up(of)
                fresh = 0
        for of in list(held):
            terms, occ, rec = sum_up(of)
            for lo in range(0, len(terms), _PIECE):
                s = slice(lo, lo + _PIECE)
                ids = (np.int64(of) << 40) + np.arange(lo, lo + len(occ[s]))
                yield pa.RecordBatch.from_arrays(
                    [terms.slice(lo, _PIECE), pa.array(ids), pa.array(occ[s]), pa.array(rec[s])],
                    ["term", "term_id", "occurrences", "records"],
                )
            del held[of]

    arrays = once.mapInArrow(count, "range int, terms array<string>, occ array<long>, rec array<long>")
    return arrays.repartitionById(parts, F.col("range")).mapInArrow(  # a range is a task
        add, "term string, term_id long, occurrences long, records long"
    )


def mark_terms(
    docs: DataFrame, key: str = "id", tokens: str = "tokens", rare: int = 2, common: float = 0.2
) -> DataFrame:
    """(term, mark): `rare` when at most `rare` ids hold the term, else `common` when more than that share does."""
    total = docs.select(key).distinct().agg(F.count(F.lit(1)).alias("n_ids"))
    records = F.col("records")
    return (
        count_terms(docs, key, tokens)
        .crossJoin(F.broadcast(total))  # one row
        .select(
            "term",
            F.when(records <= rare, "rare").when(records > F.lit(common) * F.col("n_ids"), "common").alias("mark"),
        )
        .where(F.col("mark").isNotNull())
    )
