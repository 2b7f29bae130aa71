"""Deduplicating new batches against all history (problem 5).

Method: an incremental inverted index of rare-token prefixes, partitioned by token.  The tokens of a
text are its distinct word shingles, put in a fixed order, rarest first.  Two texts with similarity t
or more share a token among the first n - ceil(t * n) + 1 of each, so only these prefixes are indexed.
Postings (token, text, number of its tokens, place in its order) lie in token ranges: one folder and
one bucket for each hash range of tokens, sorted by token.  A batch

* reads the ranges that hold its own prefix tokens, and joins them in place with its prefixes, without a
  shuffle of the history;
* drops a match unless the lengths allow the similarity and the tokens behind the place of the match on
  either side can still make up the overlap (a pair's first shared token always passes);
* drops a pair whose parity bits differ too often (the tokens folded onto `PARITY` bits by exclusive or:
  each differing bit proves a differing token);
* verifies the overlap of the rest on the whole texts, read from the parts of the text store that hold them;
* appends what is accepted to texts, bits and postings, in folders of the batch, which a repeated run
  overwrites.

The order needs no table of all tokens: a token's rarity is read from a sketch of counters on a
logarithmic scale that counted all of the history when the index was made; ties go by hash.  Any fixed
order keeps the prefix rule exact; the sketch only decides how selective the prefixes are.  Its cells
follow the history's size, one for about two tokens, up to `MOST_CELLS`; a counter does not saturate.

Within a batch a row can repeat an earlier row.  Pairs within the batch are found by the same join of
its prefixes with themselves.  Decisions are taken in rounds: rows without an undecided earlier partner
are accepted, their partners are cases.  So successive batches that are there already, `BLOCK` rows at
most, are taken as one where their order by sequence is that by number: one pass over the history for all
of them, with the same rows found.

Broadcasts: the sketch (a byte a cell, `MOST_CELLS` at most), and the parity bits of a batch, which is
taken in blocks of `BLOCK` texts (about 25 MB) for that, and the keys of texts to verify in blocks of `KEYS`
(8 MB), so that only those texts are shuffled.  The driver gets the numbers of ranges and of text
parts, never keys.

Defined results: null, empty and blank contents and those with fewer words than a shingle are never
cases; equal contents are one text, of which only the first row of a batch can be accepted; rows
without a sequence or batch number are left out; extra columns are ignored; empty tables give an empty table.
"""

from __future__ import annotations

import functools
import gc
import operator
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .near_duplicates import similarity, text_chunks
from .storage import checkpoint_dir, cut

PARITY = 1024
#: Bytes of text for a cell of the sketch (a token takes about seven), and bounds of its cells.
CELL_BYTES, LEAST_CELLS, MOST_CELLS = 16, 1 << 16, 1 << 25
#: Bytes of text for a range of tokens, and bounds of the ranges.
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 32_000_000, 12, 16384
BLOCK = 1 << 17
#: Keys of texts to verify that are broadcast at once.
KEYS = 1 << 20
_SKETCH_PARTS = 64


def _pow2(n: float) -> int:
    return 1 << max(int(np.ceil(np.log2(max(n, 1)))), 0)


def parity(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Parity bits of ragged rows of distinct tokens, as 64-bit words end to end."""
    rows = len(first) - 1
    place = np.repeat(np.arange(rows, dtype=np.int64), np.diff(first)) * PARITY + (K.mix64(values) % np.uint64(PARITY)).astype(np.int64)
    odd = (np.bincount(place, minlength=rows * PARITY) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def ordered(values: np.ndarray, first: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Distinct tokens of ragged rows in the fixed order, rarest first."""
    rarity = sketch[(values & np.uint64(len(sketch) - 1)).astype(np.int64)].astype(np.uint64)
    by_rarity = np.argsort(rarity << np.uint64(56) | values >> np.uint64(8))
    row = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))[by_rarity]
    small = row.astype(np.uint16) if len(first) <= 65536 else row
    return values[by_rarity[np.argsort(small, kind="stable")]]


def prefix_length(n: np.ndarray, threshold: float) -> np.ndarray:
    return np.where(n > 0, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, 0)


def _lists(values: np.ndarray, length: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(values.view(np.int64)))


class _Ranges:
    """A table in one folder and bucket for each hash range of its key, by batch; joins on the key read it in place."""

    def __init__(self, spark: SparkSession, folder: str, name: str, columns: str, key: str, ranges: int):
        self.spark, self.key, self.ranges = spark, key, ranges
        self.columns = [c.split()[0] for c in columns.split(", ")]
        self.table = f"{name}_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} ({columns}, batch INT, part INT) USING parquet PARTITIONED BY (batch, part) "
            f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {ranges} BUCKETS LOCATION '{folder}/{name}'"
        )

    def range_of(self, key: str | None = None) -> Column:
        return F.pmod(F.hash(key or self.key), F.lit(self.ranges))

    def put(self, rows: DataFrame, batch: int) -> None:
        """Write the rows of a batch in place of what it wrote before."""
        rows = rows.repartition(self.ranges, self.key).select(*self.columns, self.range_of().alias("part"))
        view = f"{self.table}_{batch}"
        rows.createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION (batch = {batch}, part) SELECT * FROM {view}")
        self.spark.catalog.dropTempView(view)

    def before(self, batch: int, parts: list[int]) -> DataFrame:
        """What earlier batches wrote to some ranges; the folders of the others are not read."""
        return self.spark.table(self.table).where((F.col("batch") < batch) & F.col("part").isin(parts)).select(*self.columns, "batch")

    def forget(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


class HistoryIndex:
    """The accepted texts and their postings, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None, threshold: float = 0.8, width: int = 5):
        self.spark = spark
        self.folder = folder or f"{checkpoint_dir(spark)}/history-{uuid.uuid4().hex}"
        self.threshold, self.width = threshold, width
        self._sketch: object | None = None

    # -- making -----------------------------------------------------------------------------

    def create(self, history: DataFrame, text: str = "content") -> None:
        """Start the index with the distinct texts of `history`."""
        texts = history.select(F.col(text).cast("string").alias("t")).where("t is not null and trim(t) <> ''").distinct()
        texts = texts.select(F.shiftleft(F.monotonically_increasing_id(), 1).alias("id"), "t")
        seen = Observation()
        self._put_texts(texts.observe(seen, F.sum(F.octet_length("t")).alias("bytes")), 0)
        size = seen.get["bytes"] or 0
        cells = min(max(_pow2(size / CELL_BYTES), LEAST_CELLS), MOST_CELLS)
        ranges = min(max(-(-size // RANGE_BYTES), LEAST_RANGES), MOST_RANGES)
        self.spark.createDataFrame([(cells, ranges)], "cells int, ranges int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/meta")
        self._open(cells, ranges)
        stored = self.spark.read.schema("id long, t string, part int").parquet(f"{self.folder}/texts/batch=0")
        self._count(stored.select("id", "t"))
        self.postings.put(self._postings(self._prefixed(stored.select("id", "t"), "id long, t string")), 0)

    def open(self) -> HistoryIndex:
        """Go on with an index that an earlier session made in this folder."""
        cells, ranges = self.spark.read.parquet(f"{self.folder}/meta").first()
        self._open(cells, ranges)
        for store in (self.postings, self.forms):
            self.spark.sql(f"ALTER TABLE {store.table} RECOVER PARTITIONS")
        return self

    def _open(self, cells: int, ranges: int) -> None:
        self.cells = cells
        self.postings = _Ranges(self.spark, self.folder, "postings", "token BIGINT, a BIGINT, n INT, pos INT", "token", ranges)
        self.forms = _Ranges(self.spark, self.folder, "forms", "a BIGINT, n INT, bits ARRAY<BIGINT>", "a", ranges)

    def _count(self, texts: DataFrame) -> None:
        """One pass over the texts: their parity bits, and the sketch of all their tokens."""
        width, cells, parts = self.width, self.cells, _SKETCH_PARTS
        step = cells // parts

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(cells, np.int32)
            for batch in batches:
                for part in text_chunks(batch, 1):
                    values, first = K.distinct_per_row(*K.shingles(*K.string_buffer(part.column(1)), width))
                    np.add.at(total, (values & np.uint64(cells - 1)).astype(np.int64), 1)
                    n = np.diff(first)
                    bits = _lists(parity(values, first), np.full(len(n), PARITY // 64))
                    none = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int32)), bits, *none], ["a", "n", "bits", "r", "c"]).filter(pa.array(n > 0))
            squeeze = pa.Codec("zstd", compression_level=1)
            counts = np.minimum(total, 65535).astype(np.uint16)
            packed = [squeeze.compress(counts[r * step : (r + 1) * step].tobytes(), asbytes=True) for r in range(parts)]
            none = pa.nulls(parts, pa.int64()), pa.nulls(parts, pa.int32()), pa.nulls(parts, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(parts), pa.int32()), pa.array(packed, pa.binary())], ["a", "n", "bits", "r", "c"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            squeeze = pa.Codec("zstd")
            for batch in batches:
                for r, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    one = np.frombuffer(squeeze.decompress(c, step * 2, asbytes=True), np.uint16).astype(np.int64)
                    sums[r] = sums[r] + one if r in sums else one
            for r, c in sums.items():
                level = np.minimum(np.round(8 * np.log2(1 + c)), 255).astype(np.uint8)  # full at 2^31
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["r", "c"])

        seen = cut(texts.mapInArrow(scan, "a long, n int, bits array<long>, r int, c binary"))
        self.forms.put(seen.where("a is not null"), 0)
        levels = seen.where("r is not null").select("r", "c").repartitionById(parts, F.col("r"))
        levels.mapInArrow(add, "r int, c binary").write.mode("overwrite").parquet(f"{self.folder}/sketch")

    def sketch(self):
        """Broadcast of the counters, a byte each, `MOST_CELLS` at most."""
        if self._sketch is None:
            cells = np.zeros(self.cells, np.uint8)
            step = self.cells // _SKETCH_PARTS
            for row in self.spark.read.parquet(f"{self.folder}/sketch").toLocalIterator():
                cells[row["r"] * step : (row["r"] + 1) * step] = np.frombuffer(row["c"], np.uint8)
            self._sketch = self.spark.sparkContext.broadcast(cells)
        return self._sketch

    def _prefixed(self, df: DataFrame, shape: str) -> DataFrame:
        """The rows of `df` that have a token, with n, bits and prefix; its last column is the text."""
        sketch, width, threshold = self.sketch(), self.width, self.threshold
        at = len(df.columns) - 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_chunks(batch, at):
                    values, first = K.distinct_per_row(*K.shingles(*K.string_buffer(part.column(at)), width))
                    n = np.diff(first)
                    length = prefix_length(n, threshold)
                    prefix = ordered(values, first, sketch.value)[K.ranges(first[:-1], length)]
                    bits = _lists(parity(values, first), np.full(len(n), PARITY // 64))
                    full = pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(n.astype(np.int32)), bits, _lists(prefix, length)], [*part.schema.names, "n", "bits", "prefix"]
                    )
                    yield full.filter(pa.array(n > 0))

        return df.mapInArrow(run, f"{shape}, n int, bits array<long>, prefix array<long>")

    @staticmethod
    def _postings(prefixed: DataFrame) -> DataFrame:
        """(token, a, n, pos) of every prefix token."""
        return prefixed.select(F.col("id").alias("a"), "n", F.posexplode("prefix").alias("pos", "token")).select("token", "a", "n", "pos")

    @staticmethod
    def _part_of(key: str, batch: Column) -> Column:
        """Part of the text store: the task that wrote it, for the first texts; one for each later batch."""
        return F.when(batch == 0, F.shiftright(F.col(key), 34).cast("int")).otherwise(-batch)

    def _put_texts(self, texts: DataFrame, batch: int) -> None:
        texts.withColumn("part", self._part_of("id", F.lit(batch))).write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/texts/batch={batch}")

    def _texts(self, batch: int, parts: list[int]) -> DataFrame:
        stored = self.spark.read.schema("id long, t string, batch int, part int").parquet(f"{self.folder}/texts")
        return stored.where((F.col("batch") < batch) & F.col("part").isin(parts)).select("id", "t")

    def drop(self) -> None:
        """Delete the index."""
        for store in ("postings", "forms"):
            if hasattr(self, store):
                getattr(self, store).forget()
        if self._sketch is not None:
            self._sketch.destroy()
            self._sketch = None
        _delete(self.spark, self.folder)

    # -- batches ----------------------------------------------------------------------------

    def add_batch(self, rows: DataFrame, batch: int, seq: str = "seq", text: str = "content", append: bool = True) -> DataFrame:
        """Check a batch (number 1, 2, ...) against all that is accepted, and append what it brings, unless told not to.

        Returns (seq), the rows that bring no new content.
        """
        kind = rows.schema[seq].dataType.simpleString()
        src = rows.select(F.col(seq).cast("long").alias("s"), F.col(text).cast("string").alias("t"))
        src = src.where("s is not null and t is not null and trim(t) <> ''")
        classes = src.groupBy("t").agg(F.min("s").alias("s")).select(F.shiftleft("s", 1).bitwiseOR(F.lit(1)).alias("id"), "s", "t")
        own = cut(self._prefixed(classes, "id long, s long, t string"))
        cases = self._settle(self._verify(self._probe(own, batch), own, batch))
        repeats = src.join(own.select(F.col("s").alias("first"), "t"), "t").where("s > first").select("s")
        found = own.join(cases, "id", "left_semi").select("s").unionByName(repeats)
        if append:
            self._append(own.join(cases, "id", "left_anti"), batch)
        return found.select(F.col("s").cast(kind).alias(seq))

    def _append(self, fresh: DataFrame, batch: int) -> None:
        """Store accepted texts; `fresh` is read three times, each time a small anti-join."""
        with ThreadPoolExecutor(3) as pool:
            done = [
                pool.submit(self._put_texts, fresh.select("id", "t"), batch),
                pool.submit(self.forms.put, fresh.select(F.col("id").alias("a"), "n", "bits"), batch),
                pool.submit(self.postings.put, self._postings(fresh), batch),
            ]
        for d in done:
            d.result()

    def _can_reach(self, one: tuple[Column, Column], two: tuple[Column, Column]) -> Column:
        """Whether a match at these (size, place) can be the first shared token of a pair that reaches the threshold."""
        (n, i), (m, j) = one, two
        t = self.threshold
        need = F.ceil(F.lit(t / (1 + t)) * (n + m) - F.lit(1e-9))
        return (F.least(n, m) >= F.lit(t) * F.greatest(n, m) - F.lit(1e-9)) & (F.least(n - i, m - j) >= need)

    def _probe(self, own: DataFrame, batch: int) -> DataFrame:
        """(a, b, old, part): pairs of an earlier and a new text that can reach the threshold, and where a lies."""
        t = self.threshold
        mine = self._postings(own)
        parts = [r[0] for r in mine.select(self.postings.range_of()).distinct().collect()]  # numbers of ranges
        blocks = -(-own.count() // BLOCK)
        earlier = self.postings.before(batch, parts)
        forms = self.forms.before(batch, list(range(self.forms.ranges)))
        theirs = own.select(F.col("id").alias("a"), "n", "bits", F.lit(0).alias("batch"))
        found = []
        shuffled = lambda postings: postings.dropna().repartition(self.postings.ranges, "token")  # noqa: E731 - the same plan for every join, so that it runs once
        for block in range(blocks):
            one_block = own.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block) if blocks > 1 else own
            probes = shuffled(self._postings(one_block)).select("token", F.col("a").alias("b"), F.col("n").alias("m"), F.col("pos").alias("at"))
            match = self._can_reach((F.col("n"), F.col("pos")), (F.col("m"), F.col("at")))
            old = earlier.join(probes.hint("shuffle_hash"), "token").where(match).select("a", "b")
            new = shuffled(mine).join(probes.hint("shuffle_hash"), "token").where(match & (F.col("a") < F.col("b"))).select("a", "b")
            sent = F.broadcast(one_block.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("bits").alias("own")))  # BLOCK rows at most
            differ = functools.reduce(operator.add, (F.bit_count(F.col("bits")[w].bitwiseXOR(F.col("own")[w])) for w in range(PARITY // 64)))
            most = F.col("n") + F.col("m")
            alike = most - differ >= 2 * F.ceil(F.lit(t / (1 + t)) * most - F.lit(1e-9))
            for pairs, held, is_old in ((old, forms, True), (new, theirs, False)):
                met = pairs.repartition(self.forms.ranges, "a").join(held.hint("shuffle_hash"), "a").join(sent, "b")
                part = self._part_of("a", F.col("batch"))
                found.append(met.where(alike).select("a", "b", F.lit(is_old).alias("old"), part.alias("part")).distinct())
        shape = "a long, b long, old boolean, part int"
        return cut(functools.reduce(DataFrame.unionByName, found)) if found else self.spark.createDataFrame([], shape)

    def _verify(self, pairs: DataFrame, own: DataFrame, batch: int) -> DataFrame:
        """The pairs whose texts have the similarity."""
        parts = [r[0] for r in pairs.where("old").select("part").distinct().collect()]  # numbers of parts
        stored = self._texts(batch, parts)
        blocks = -(-pairs.count() // KEYS)
        wanted = pairs.where("old").select(F.col("a").alias("id")).distinct()
        chosen = [stored.join(F.broadcast(wanted.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)), "id", "left_semi") for b in range(blocks)]
        left = functools.reduce(DataFrame.unionByName, chosen) if chosen else stored.where("false")
        old = left.select(F.col("id").alias("a"), F.col("t").alias("ta")).join(pairs.where("old"), "a")
        new = own.select(F.col("id").alias("a"), F.col("t").alias("ta")).join(pairs.where("not old"), "a")
        both = old.unionByName(new).join(own.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "old", "ta", "tb")
        width, threshold = self.width, self.threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                for lo in range(0, part.num_rows, 1024):
                    p = part.slice(lo, 1024)
                    good = similarity(p.column(3), p.column(4), width) >= threshold
                    yield p.select(["a", "b", "old"]).filter(pa.array(good))

        return cut(both.mapInArrow(run, "a long, b long, old boolean"))

    @staticmethod
    def _settle(edges: DataFrame) -> DataFrame:
        """(id): texts of the batch that repeat an accepted one; edges: (a, b, old), a before b in the batch or old."""
        known = edges.where("old").select(F.col("b").alias("id")).distinct()
        cases, left = known, _without(edges.where("not old").select("a", "b"), known)
        while True:
            later = left.select(F.col("b").alias("a"), F.lit(True).alias("waits")).distinct()
            state = cut(left.join(later, "a", "left").select("a", "b", "waits"))
            if state.isEmpty():
                return cases.distinct()
            hit = state.where("waits is null").select(F.col("b").alias("id")).distinct()
            cases = cases.unionByName(hit)
            left = _without(state.select("a", "b"), hit)


def _without(edges: DataFrame, cases: DataFrame) -> DataFrame:
    """The edges that decided cases leave open."""
    for end in ("b", "a"):
        edges = edges.join(cases.select(F.col("id").alias(end)), end, "left_anti")
    return edges.select("a", "b")


def _release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files, broadcasts and checkpoints of a step that is done.

    It acts on what the driver's garbage collection finds, which a mostly idle driver would put off.
    """
    gc.collect()
    spark._jvm.System.gc()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _groups(batches: DataFrame, number: str, seq: str) -> list[tuple]:
    """(first, last number) of successive batches that are taken as one: `BLOCK` rows at most, and their order by sequence is that by number."""
    s = F.col(seq).cast("long")
    spans = batches.where(F.col(number).isNotNull()).groupBy(number).agg(F.count(s), F.min(s), F.max(s)).collect()
    groups: list[list] = []
    for n, rows, low, high in sorted(x for x in spans if x[1]):
        if groups and groups[-1][2] + rows <= BLOCK and groups[-1][3] < low:
            groups[-1] = [groups[-1][0], n, groups[-1][2] + rows, high]
        else:
            groups.append([n, n, rows, high])
    return [(first, last) for first, last, _, _ in groups]


def rows_without_new_content(
    history: DataFrame,
    batches: DataFrame,
    number: str = "batch_no",
    seq: str = "seq",
    text: str = "content",
    threshold: float = 0.8,
    width: int = 5,
) -> DataFrame:
    """(seq) of the rows of all batches, taken in order of their numbers, that bring no new content."""
    index = HistoryIndex(history.sparkSession, None, threshold, width)
    index.create(history, text)
    _release(index.spark)
    found, groups = [], _groups(batches, number, seq)
    for i, (first, last) in enumerate(groups, 1):
        rows = batches.where(F.col(number).between(first, last))
        found.append(cut(index.add_batch(rows, i, seq, text, append=i < len(groups))))  # the index is dropped after the last
        _release(index.spark)
    index.drop()
    return functools.reduce(DataFrame.unionByName, found) if found else batches.select(seq).where("false")
