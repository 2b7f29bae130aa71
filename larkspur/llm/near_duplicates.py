"""Near-duplicate texts (problem 1).

Method: vantage-point trees over fingerprints.  A text's fingerprint has one bit of each of `BITS`
minima over its set of word shingles, so the Hamming distance of two fingerprints estimates their
similarity J as BITS * (1 - J) / 2.  Fingerprints are placed in overlapping shards, and within each
shard a vantage-point tree finds every two within the radius that belongs to the threshold, pruning
branches by the triangle inequality.  The pairs found are verified on the whole texts, exactly.

Which shards: a vantage point cannot cut the collection as a whole at these thresholds.  Unrelated
fingerprints lie 122 +- 8 bits of 256 apart, the radius for J >= 0.5 is 89, so d(x, v) says nothing
about which far branch to skip, and every boundary strip would hold all points.  So a coarse first cut
goes before the trees: a fingerprint lies in the shards of `HASHES / ROWS` bands of `ROWS` of its minima.
Bands that short gather unrelated texts beside similar ones; they lose a pair of J = 0.5 with probability
2.7e-6, of 0.55 with 3e-8, whatever the collection's size.  The trees search every shard of two or more
texts; a branch is skipped where the vantage point's own group of near copies is told from the rest.
The radius loses a pair at the threshold itself with probability 2.3e-4 (3.5 standard deviations).

A shard of more than `LIMIT` texts is split into blocks, and each pair of blocks is one task's tree
query, so that no task holds more than two blocks.  Equal texts are one point; `near_duplicate_classes`
gives the classes and the pairs between them, one row a text, and is the result to use at scale;
`near_duplicate_pairs` expands them to all pairs of ids, in blocks of `LIMIT` ids of a class.

Defined results: rows of one id count once; null ids and null contents are no cases; texts with
fewer words than a shingle are never cases; equal texts are pairs; extra columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import cut
from .vptree import Forest, VPTree

HASHES = 288
ROWS = 3
BITS = 256
LIMIT = 4096
_CHUNK = 1 << 20
_WORDS = BITS // 64
_FP = [f"f{k}" for k in range(_WORDS)]


def radius(threshold: float, hashes: int = BITS, deviations: float = 3.5) -> int:
    """Hamming distance that a pair at the threshold exceeds only beyond so many standard deviations."""
    p = (1 - threshold) / 2
    return int(np.ceil(hashes * p + deviations * np.sqrt(hashes * p * (1 - p))))


def minima(shingles: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows with shingles, HASHES minima of each of them)."""
    rows = np.flatnonzero(np.diff(first))
    out = np.empty((len(rows), HASHES), np.uint32)
    if len(rows):
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        rng = np.random.default_rng(20240131)
        a = rng.integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        b = rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(x * a[k] + b[k], first[rows])
    return rows, out


def _fingerprint(m: np.ndarray) -> np.ndarray:
    bits = ((m[:, :BITS] * np.uint32(2654435761)) >> np.uint32(31)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _bands(m: np.ndarray) -> np.ndarray:
    out = np.empty((len(m), HASHES // ROWS), np.uint64)
    for b in range(HASHES // ROWS):
        h = np.full(len(m), b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            h = K.mix64(h * np.uint64(0x2545F4914F6CDD1D) + m[:, k])
        out[:, b] = h
    return out


def text_chunks(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `_CHUNK` bytes of text."""
    _, off = K.string_buffer(batch.column(text))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + _CHUNK, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def signatures(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(k, h, f0.., bands): hash of the text, fingerprint and shards of every row with a shingle."""
    src = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("k is not null and t is not null")
    kind = src.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, 1):
                raw, off = K.string_buffer(part.column(1))
                rows, m = minima(*K.shingles(raw, off, width))
                h = K.SegmentHash(raw, 41)(off[:-1][rows], off[1:][rows])
                fp, bands = _fingerprint(m), _bands(m)
                to = np.arange(len(rows) + 1, dtype=np.int32) * bands.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows)),
                        pa.array(h.view(np.int64)),
                        *(pa.array(np.ascontiguousarray(fp[:, w]).view(np.int64)) for w in range(_WORDS)),
                        pa.ListArray.from_arrays(pa.array(to), pa.array(bands.ravel().view(np.int64))),
                    ],
                    ["k", "h", *_FP, "bands"],
                )

    return src.mapInArrow(run, f"k {kind}, h long, {', '.join(f + ' long' for f in _FP)}, bands array<long>")


def _points(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(f).to_numpy().view(np.uint64) for f in _FP], axis=1)


def _pairs_of_runs(shard: np.ndarray, points: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within the radius in each run of equal shards; rows are sorted by shard."""
    start = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    return Forest(points, r).pairs(start, np.diff(np.append(start, len(shard))))


def _pair_batch(a: np.ndarray, b: np.ndarray, over: pa.RecordBatch | None = None) -> pa.RecordBatch:
    """Rows of pairs, and the members of shards that are too large for one task."""
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    n = over.num_rows if over else 0
    none = pa.nulls(len(lo), pa.int64())
    cols = [pa.concat_arrays([pa.array(lo), over.column("h")]) if n else pa.array(lo)]
    cols.append(pa.concat_arrays([pa.array(hi), pa.nulls(n, pa.int64())]))
    for c in ("shard", *_FP):
        cols.append(pa.concat_arrays([none, over.column(c)]) if n else none)
    return pa.RecordBatch.from_arrays(cols, ["a", "b", "shard", *_FP])


_PAIR_SCHEMA = "a long, b long, shard long, " + ", ".join(f + " long" for f in _FP)


def candidate_pairs(points: DataFrame, r: int) -> DataFrame:
    """Distinct (a, b), a < b, of text hashes within the radius; points: h, f0.., bands."""
    rows = points.select(F.explode("bands").alias("shard"), "h", *_FP)
    rows = rows.repartition("shard").sortWithinPartitions("shard")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        hot: int | None = None

        def done(part: pa.RecordBatch) -> pa.RecordBatch:
            h = part.column("h").to_numpy()
            i, j = _pairs_of_runs(part.column("shard").to_numpy(), _points(part), r)
            pair = np.unique(np.stack([np.minimum(h[i], h[j]), np.maximum(h[i], h[j])], axis=1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
            return _pair_batch(pair[:, 0].copy(), pair[:, 1].copy())

        empty = np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            shard = batch.column("shard").to_numpy()
            last = int(np.searchsorted(shard, shard[-1], "left"))
            if hot is not None:  # the run of a large shard goes on
                upto = int(np.searchsorted(shard, hot, "right"))
                if upto:
                    yield _pair_batch(empty, empty, batch.slice(0, upto))
                batch, shard, last = batch.slice(upto), shard[upto:], last - upto
                if not len(shard):
                    held = None
                    continue
                hot = None
            if last:
                yield done(batch.slice(0, last))
            held = batch.slice(last)
            if held.num_rows > LIMIT:
                yield _pair_batch(empty, empty, held)
                hot, held = int(shard[-1]), None
        if held is not None and held.num_rows:
            yield done(held)

    found = cut(rows.mapInArrow(search, _PAIR_SCHEMA))
    pairs = found.where("b is not null").select("a", "b")
    over = found.where("b is null").select(F.col("a").alias("h"), "shard", *_FP)
    if not over.isEmpty():
        pairs = pairs.unionByName(_large_shards(over, r))
    return pairs.distinct()


def _large_shards(over: DataFrame, r: int) -> DataFrame:
    """Pairs within shards of any size, block against block."""
    sizes = over.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / LIMIT).cast("int").alias("n"))
    own = over.join(sizes, "shard").withColumn("x", F.pmod(F.xxhash64("h"), F.col("n")).cast("int"))
    blocks = own.select(
        "shard", "h", *_FP, "x", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("y")
    ).select("shard", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "h", *_FP)
    blocks = blocks.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            b = pa.concat_batches(held)
            i, j, x, h = (b.column(c).to_numpy() for c in ("i", "j", "x", "h"))
            pts = _points(b)
            one, two = np.flatnonzero(x == i), np.flatnonzero(x == j)
            if not len(one) or not len(two):
                return
            same = i[0] == j[0]
            for q, p in VPTree(pts[two]).within(pts[one], r):
                keep = q < p if same else np.ones(len(q), bool)
                yield _pair_batch(h[one[q[keep]]], h[two[p[keep]]])

        now = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("shard", "i", "j")], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else []
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                key = tuple(keys[a])
                if key != now and held:
                    yield from done()
                    held = []
                now = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from done()

    return blocks.mapInArrow(search, _PAIR_SCHEMA).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """Pairs (a, b) whose texts have similarity `threshold` or more; texts: (h, t), one row each."""
    left = texts.select(F.col("h").alias("a"), F.col("t").alias("ta"))
    right = texts.select(F.col("h").alias("b"), F.col("t").alias("tb"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                good = similarity(part.column(2), part.column(3), width) >= threshold
                yield part.select(["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(run, "a long, b long")


def similarity(one: pa.Array, two: pa.Array, width: int) -> np.ndarray:
    """Exact Jaccard similarity of the shingle sets of two columns of texts, row by row; 0 without shingles."""
    n = len(one)
    sets = [K.distinct_per_row(*K.shingles(*K.string_buffer(c), width)) for c in (one, two)]
    size = [np.diff(f) for _, f in sets]
    row = np.concatenate([np.repeat(np.arange(n), s) for s in size])
    both = np.concatenate([v for v, _ in sets])
    order = np.lexsort((both, row))
    v, r = both[order], row[order]
    shared = np.bincount(r[1:][(v[1:] == v[:-1]) & (r[1:] == r[:-1])], minlength=n) if len(v) > 1 else np.zeros(n)
    total = size[0] + size[1] - shared
    return np.where(total > 0, shared / np.maximum(total, 1), 0.0)


def near_duplicate_pairs(
    docs: DataFrame, key: str = "id", text: str = "content", threshold: float = 0.8, width: int = 5
) -> DataFrame:
    """(id_a, id_b): all pairs of keys, the smaller first, whose texts' shingle sets are that similar."""
    classes, pairs = near_duplicate_classes(docs, key, text, threshold, width)
    sizes = classes.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / LIMIT).cast("int").alias("n"))
    blocked = classes.join(sizes, "h").withColumn("i", F.pmod(F.xxhash64("k"), F.col("n")).cast("int"))
    side = lambda h, k, i: blocked.select(F.col("h").alias(h), F.col("k").alias(k), F.col("i").alias(i))
    blocks = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one, two = side("a", "x", "i"), side("b", "y", "j")
    for end, n in (("a", "na"), ("b", "nb")):
        pairs = pairs.join(sizes.select(F.col("h").alias(end), F.col("n").alias(n)), end)
    apart = pairs.withColumn("i", blocks("na")).withColumn("j", blocks("nb")).join(one, ["a", "i"]).join(two, ["b", "j"])
    several = classes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h").alias("a"), F.ceil(F.col("n") / LIMIT).cast("int").alias("na"))
    own = several.withColumn("b", F.col("a")).withColumn("i", blocks("na")).withColumn("j", blocks("na"))
    equal = own.join(one, ["a", "i"]).join(two, ["b", "j"]).where("x < y")
    return apart.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).unionByName(
        equal.select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    )


def near_duplicate_classes(
    docs: DataFrame, key: str = "id", text: str = "content", threshold: float = 0.8, width: int = 5
) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs): the class h of equal texts of every key k; pairs (a, b) of similar classes."""
    sig = signatures(docs, key, text, width)
    kept = cut(
        sig.groupBy("k").agg(*(F.first(c).alias(c) for c in ("h", *_FP, "bands")))  # rows of one key are equal
    )
    classes = kept.select("h", "k")
    points = kept.groupBy("h").agg(F.min("k").alias("k"), *(F.first(c).alias(c) for c in (*_FP, "bands")))
    found = cut(candidate_pairs(points, radius(threshold)))
    ends = found.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    chosen = classes.groupBy("h").agg(F.min("k").alias("k")).join(ends, "h", "left_semi")
    texts = (
        docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
        .where("t is not null")
        .join(chosen, "k")
        .dropDuplicates(["h"])
        .select("h", "t")
    )
    return classes, verified(found, texts, threshold, width)
