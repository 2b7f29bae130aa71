"""One consistent form of texts that look alike (problem 8).

Method: script-aware repair.  First the characters whose look is defined by Unicode are unified:
width forms, kinds of space, joined Latin letters, composed accents; characters that print nothing
are dropped.  Then tokens are repaired.  A token is a candidate when it mixes scripts, or when all its
letters could as well be Latin.  Its class is what it reads as with every look-alike taken as Latin;
the corpus's own vocabulary of unmixed tokens is asked for words of that class, and the look-alikes
are substituted so that the token becomes the word that is known: in Latin, else in Cyrillic, Greek or
Armenian.  A class of which the vocabulary knows no word is settled by its letters: those of the one
script that the letters without a look-alike belong to, if all can be written in it, else Latin.

So the form of a token depends on its class and the corpus alone, and two texts have equal canonical
texts exactly when they look the same.  `canonical_text` writes that text; the keys of `lookalike_pairs`
are 128-bit hashes of it.

Shuffles: distinct class hashes of each block (not tokens) meet the candidates' hashes; texts are
shuffled once, by key, to meet their findings; pairs are formed between distinct variants only and
expanded to documents at the end, in blocks of `PER_BLOCK` documents of a variant, so that no task
holds all of a large class.

Defined results: null, empty and blank texts are never cases; letter case, accents, raised digits,
the number of spaces, tabs and line ends differ visibly and are kept; identical texts are no pair;
rows with a null key are left out of pairs; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import cut

#: Letters of other scripts and their Latin look-alikes.
CYRILLIC_SHAPES = {
    "а": "a", "А": "A", "В": "B", "с": "c", "С": "C", "ԁ": "d", "е": "e", "Е": "E", "һ": "h", "Н": "H", "і": "i",
    "І": "I", "ј": "j", "Ј": "J", "К": "K", "ӏ": "l", "М": "M", "о": "o", "О": "O", "р": "p", "Р": "P", "ԛ": "q",
    "Ԛ": "Q", "ѕ": "s", "Ѕ": "S", "Т": "T", "ԝ": "w", "Ԝ": "W", "х": "x", "Х": "X", "у": "y", "У": "Y", "ѵ": "v",
}
GREEK_SHAPES = {
    "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "ο": "o", "Ο": "O", "Ρ": "P",
    "Τ": "T", "ν": "v", "Χ": "X", "Υ": "Y", "Ζ": "Z", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J",
}
ARMENIAN_SHAPES = {"օ": "o", "Օ": "O", "ո": "n", "ս": "u", "հ": "h", "Տ": "S", "Ս": "U", "ց": "g"}
#: Latin letters shaped like others.
LATIN_SHAPES = {"ɡ": "g", "ı": "i", "ɑ": "a"}

LATIN, CYRILLIC, GREEK, ARMENIAN = SCRIPTS = (1, 2, 3, 4)
_NAMES = {"LATIN": LATIN, "CYRILLIC": CYRILLIC, "GREEK": GREEK, "ARMENIAN": ARMENIAN}
#: Documents of one variant in a block of pairs.
PER_BLOCK = 512
_CHUNK = 1 << 22
_END = 0x20000


class _Tables:
    """Look-up tables over code points, built from the Unicode database once in each worker."""

    def __init__(self) -> None:
        self.one = np.arange(0x110000, dtype=np.uint32)  # folded form, where it is one code point
        self.count = np.ones(0x110000, np.uint8)  # code points of the folded form
        self.many: dict[int, list[int]] = {}
        self.letter = np.zeros(0x110000, bool)
        self.mark = np.zeros(0x110000, bool)
        self.script = np.zeros(0x110000, np.uint8)
        for c in range(_END):
            ch = chr(c)
            kind = ud.category(ch)
            self.letter[c] = kind[0] in "LM"
            self.mark[c] = kind[0] == "M"
            if c < 0x2E00 and kind[0] == "L":
                self.script[c] = _NAMES.get(ud.name(ch, "").partition(" ")[0], 0)
            to = self._fold(ch, kind)
            if len(to) == 1:
                self.one[c] = ord(to)
            else:
                self.count[c] = len(to)
                if to:
                    self.many[c] = [ord(x) for x in to]
        for c in range(0xE0100, 0xE01F0):
            self.count[c] = 0
        self.wide = np.zeros(0x110000, bool)
        self.wide[list(self.many)] = True
        own = {CYRILLIC: CYRILLIC_SHAPES, GREEK: GREEK_SHAPES, ARMENIAN: ARMENIAN_SHAPES, LATIN: LATIN_SHAPES}
        self.latin = np.arange(0x110000, dtype=np.uint32)  # every look-alike read as Latin
        self.to = {x: np.arange(0x110000, dtype=np.uint32) for x in SCRIPTS}  # that reading written in a script
        for script, shapes in own.items():
            for a, b in shapes.items():
                self.latin[ord(a)] = ord(b)
                if script != LATIN:
                    self.to[script][ord(b)] = ord(a)

    @staticmethod
    def _fold(ch: str, kind: str) -> str:
        d = ud.decomposition(ch)
        if kind == "Cf" or 0xFE00 <= ord(ch) <= 0xFE0F or ord(ch) in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0):
            return ""
        if kind == "Zs":
            return " "
        if d.startswith(("<wide>", "<narrow>")):
            return ud.normalize("NFD", "".join(chr(int(x, 16)) for x in d.split()[1:]))
        if d.startswith("<compat>") and kind[0] == "L" and ("LATIN" in (n := ud.name(ch, "")) and ("LIGATURE" in n or "DIGRAPH" in n) or ch in "ĲĳǇǈǉǊǋǌǱǲǳ"):
            return ud.normalize("NFKD", ch)
        return ud.normalize("NFD", ch) if d and not d.startswith("<") else ch


_TABLES: list[_Tables] = []


def tables() -> _Tables:
    if not _TABLES:
        _TABLES.append(_Tables())
    return _TABLES[0]


def fold(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unified characters in decomposed form: (code points, text borders)."""
    t = tables()
    if len(cps) == 0 or int(cps.max()) < 0x80:
        return cps, off
    n = t.count[cps].astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(upto[-1], np.uint32)
    single = n == 1
    out[upto[:-1][single]] = t.one[cps[single]]
    for i in np.flatnonzero(t.wide[cps]).tolist():
        to = t.many[int(cps[i])]
        out[upto[i] : upto[i] + len(to)] = to
    new = upto[off]
    # two marks in a row may stand in either order, Hangul letters may be composed: take the slow way
    mark = t.mark[out]
    odd = np.flatnonzero((mark[1:] & mark[:-1]) | ((out[1:] >= 0x1100) & (out[1:] < 0x1200))) if len(out) > 1 else []
    if len(odd):
        rows = np.unique(np.searchsorted(new, odd, "right") - 1)
        parts = [out[a:b] for a, b in zip(new[:-1].tolist(), new[1:].tolist())]
        for r in rows.tolist():
            s = ud.normalize("NFD", "".join(map(chr, parts[r].tolist())))
            s = "".join(ud.normalize("NFC", x) if 0x1100 <= ord(x[0]) < 0x1200 else x for x in _jamo(s))
            parts[r] = np.array([ord(x) for x in s], np.uint32)
        new = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        out = np.concatenate(parts) if parts else out
    return out, new


def _jamo(s: str) -> list[str]:
    runs: list[str] = []
    for ch in s:
        inside = 0x1100 <= ord(ch) < 0x1200
        if runs and inside and 0x1100 <= ord(runs[-1][0]) < 0x1200:
            runs[-1] += ch
        else:
            runs.append(ch)
    return runs


class Tokens:
    """The runs of letters of unified texts, and which of them are to be repaired."""

    def __init__(self, cps: np.ndarray, off: np.ndarray):
        t = tables()
        n = len(cps)
        letter = t.letter[cps]
        head = np.zeros(n + 1, bool)
        head[off] = True
        start = letter.copy()
        start[1:] &= ~letter[:-1]
        start |= letter & head[:n]
        after = np.zeros(n + 1, bool)
        after[1:] = letter
        after[:n] &= ~letter
        after |= head & np.append(False, letter)
        self.start, self.end = s, e = np.flatnonzero(start), np.flatnonzero(after)
        self.row = np.searchsorted(off, s, "right") - 1
        self.latin = t.latin[cps]
        count = lambda where: (c := np.concatenate([[0], np.cumsum(where)]))[e] - c[s]
        script = t.script[cps]
        per = np.stack([count(script == x) for x in SCRIPTS])
        own = np.stack([count(t.script[self.latin] == x) for x in SCRIPTS[1:]]).sum(axis=0)  # letters without a look-alike
        alike = count(self.latin != cps) > 0
        self.script = per.argmax(axis=0).astype(np.uint8) + 1
        unmixed = (per > 0).sum(axis=0) == 1
        self.candidate = ((per > 0).sum(axis=0) > 1) | (alike & (own == 0))
        self.word = unmixed & ((self.script != LATIN) | ~alike)
        self.key = K.SegmentHash(self.latin, 21)(s, e)

    def written(self, cps: np.ndarray, which: np.ndarray, script: np.ndarray) -> np.ndarray:
        """The code points with the chosen tokens written in the given scripts; 0: by their letters."""
        t = tables()
        s, e = self.start[which], self.end[which]
        idx = K.ranges(s, e - s)
        of = np.repeat(np.arange(len(s)), e - s)
        if (script == 0).any():
            kinds = t.script[self.latin[idx]]
            script = script.copy()
            held = np.stack([np.bincount(of, kinds == x, len(s)) > 0 for x in SCRIPTS[1:]])
            for x in SCRIPTS[1:]:
                rest = np.bincount(of, t.script[t.to[x][self.latin[idx]]] == LATIN, len(s)) == 0
                script[(script == 0) & rest & held[x - 2] & (held.sum(axis=0) == 1)] = x
            script[script == 0] = LATIN
        out = cps.copy()
        for x in SCRIPTS:
            i = idx[script[of] == x]
            out[i] = t.to[x][self.latin[i]]
        return out


def _chunks(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    _, off = K.string_buffer(batch.column(text))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + _CHUNK, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _ascii_rows(col: pa.Array) -> np.ndarray:
    """Which texts are plain ASCII: nothing to unify in them, and no token of mixed scripts."""
    raw, off = K.string_buffer(col)
    high = np.concatenate([[0], np.cumsum(raw > 0x7F)])
    return high[off[1:]] == high[off[:-1]]


def _ascii_tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters of ASCII texts: (starts, ends)."""
    letter = tables().letter[raw]
    step = np.diff(np.append(letter, False).astype(np.int8), prepend=np.int8(0))
    s, e = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = off[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(raw))])
    cuts = cuts[letter[cuts] & letter[cuts - 1]]
    return np.sort(np.concatenate([s, cuts])), np.sort(np.concatenate([e, cuts]))


def approved_repairs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, h, script): for documents with candidates, their classes and the scripts of the words the corpus knows.

    Script 0 stands for a class of which the vocabulary has no word.
    """
    src = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("t is not null")
    kind = src.schema["k"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, 1):
                plain = _ascii_rows(part.column(1))
                raw, off = K.string_buffer(part.column(1).filter(pa.array(plain)))
                known = np.unique(K.SegmentHash(raw, 21)(*_ascii_tokens(raw, off)))
                part = part.filter(pa.array(~plain))
                cps, off = fold(*K.code_points(part.column(1)))
                t = Tokens(cps, off)
                words = [np.unique(t.key[t.word & (t.script == x)]) for x in SCRIPTS]
                words[0] = np.unique(np.concatenate([words[0], known]))
                at = np.flatnonzero(t.candidate)
                size = [len(w) for w in words]
                script = np.concatenate([np.repeat(SCRIPTS, size), np.zeros(len(at), np.int64)]).astype(np.int8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.nulls(sum(size), part.schema.field(0).type), part.column(0).take(pa.array(t.row[at]))]),
                        pa.array(np.concatenate([*words, t.key[at]]).view(np.int64)),
                        pa.array(script),
                    ],
                    ["k", "h", "script"],
                )

    seen = cut(src.mapInArrow(scan, f"k {kind}, h long, script byte"))  # one scan; words are distinct by block
    words = seen.where("script > 0").groupBy("h").agg(F.min("script").alias("script"))
    wanted = seen.where("script = 0").select("k", "h").distinct()
    found = wanted.join(words, "h", "left").select("k", F.struct("h", F.coalesce("script", F.lit(0)).cast("int").alias("script")).alias("x"))
    return found.groupBy("k").agg(F.collect_list("x").alias("x")).select("k", "x.h", "x.script")


def _repaired(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Unified and repaired code points of the texts in column 1, by the findings in columns 2 and 3."""
    cps, off = fold(*K.code_points(part.column(1)))
    lists = part.column(2)
    if lists.null_count == len(lists):
        return cps, off
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    mixed = lambda h, row: K.mix64(h ^ K.mix64(row.astype(np.uint64)))
    known = mixed(lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(lists)), sizes))
    order = np.argsort(known)
    known, script = known[order], part.column(3).flatten().to_numpy()[order]
    t = Tokens(cps, off)
    which = np.flatnonzero(t.candidate)
    own = mixed(t.key[which], t.row[which])
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    found = known[at] == own
    return t.written(cps, which[found], script[at[found]]), off


def _composed(part: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    """Canonical texts of column 1, and which of them are not blank."""
    cps, off = _repaired(part)
    solid = np.zeros(part.num_rows, bool)
    solid[_solid(cps, off)] = True
    return [x if x.isascii() else ud.normalize("NFC", x) for x in K.strings_from_code_points(cps, off)], solid


def _with_repairs(docs: DataFrame, key: str, text: str) -> DataFrame:
    src = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return src.join(approved_repairs(docs, key, text), "k", "left").select("k", "t", "h", "script")


def canonical_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, canonical): each text in its consistent, composed form; null stays null."""
    src = _with_repairs(docs, key, text)
    kind = src.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, 1):
                texts = part.column(1)
                plain = _ascii_rows(texts)
                if not plain.all():
                    done, _ = _composed(part.filter(pa.array(~plain)))
                    texts = pc.replace_with_mask(texts, pa.array(~plain), pa.array(done, texts.type))
                yield pa.RecordBatch.from_arrays([part.column(0), texts], ["k", "canonical"])

    return src.mapInArrow(run, f"k {kind}, canonical string").withColumnRenamed("k", key)


def _solid(symbols: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts that are not blank."""
    upto = np.concatenate([[0], np.cumsum(K.char_classes()[symbols] != K.SPACE)])
    return np.flatnonzero(upto[off[1:]] > upto[off[:-1]])


def _key_batch(keys: pa.Array, rows: np.ndarray, cols: list[np.ndarray]) -> pa.RecordBatch:
    lists = [keys.take(pa.array(rows)), *(pa.array(c.view(np.int64)) for c in cols)]
    return pa.RecordBatch.from_arrays(lists, ["k", "look_a", "look_b", "raw_a", "raw_b"])


def visual_keys(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, look_a, look_b, raw_a, raw_b): 128-bit keys of the canonical and of the stored text, blank texts left out."""
    src = _with_repairs(docs, key, text)
    kind = src.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, 1):
                plain = _ascii_rows(part.column(1))
                easy = part.filter(pa.array(plain))
                raw, at = K.string_buffer(easy.column(1))
                rows = _solid(raw, at)
                cols = [K.SegmentHash(raw, seed)(at[:-1][rows], at[1:][rows]) for seed in (31, 32)]
                yield _key_batch(easy.column(0), rows, cols * 2)
                part = part.filter(pa.array(~plain))
                if not part.num_rows:
                    continue
                done, solid = _composed(part)
                rows = np.flatnonzero(solid)
                both = K.string_buffer(pa.array(done, pa.string())), K.string_buffer(part.column(1))
                cols = [K.SegmentHash(x, seed)(o[:-1][rows], o[1:][rows]) for x, o in both for seed in (31, 32)]
                yield _key_batch(part.column(0), rows, cols)

    return src.mapInArrow(run, f"k {kind}, look_a long, look_b long, raw_a long, raw_b long")


def lookalike_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, look): the class of texts that look the same of every document whose text is not blank."""
    look = F.concat(F.lpad(F.hex("look_a"), 16, "0"), F.lpad(F.hex("look_b"), 16, "0"))
    return visual_keys(docs, key, text).select(F.col("k").alias(key), look.alias("look"))


def lookalike_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_a, doc_b): every two documents whose texts differ but look the same, the smaller key first."""
    keys = cut(visual_keys(docs, key, text).where("k is not null"))
    look, raw = ["look_a", "look_b"], ["raw_a", "raw_b"]
    variants = keys.groupBy(*look, *raw).agg(F.ceil(F.count(F.lit(1)) / PER_BLOCK).cast("int").alias("n"))
    several = variants.groupBy(*look).agg(F.count(F.lit(1)).alias("v")).where("v > 1").select(*look)
    forms = cut(variants.join(several, look, "left_semi").select(*look, *raw, "n"))
    kept = keys.join(forms, [*look, *raw]).withColumn("i", F.pmod(F.xxhash64("k"), F.col("n")).cast("int"))
    side = lambda p: forms.select(*look, F.col("raw_a").alias(f"{p}_a"), F.col("raw_b").alias(f"{p}_b"), F.col("n").alias(f"{p}_n"))
    pairs = side("l").join(side("r"), look).where("l_a < r_a or (l_a = r_a and l_b < r_b)")
    for p in "lr":  # blocks of documents of either variant
        pairs = pairs.withColumn(f"{p}_i", F.explode(F.sequence(F.lit(0), F.col(f"{p}_n") - 1)))
    docs_of = lambda p, x: kept.select(*look, *(F.col(c).alias(f"{p}_{c[-1]}") for c in raw), F.col("i").alias(f"{p}_i"), F.col("k").alias(x))
    found = pairs.join(docs_of("l", "x"), [*look, "l_a", "l_b", "l_i"]).join(docs_of("r", "y"), [*look, "r_a", "r_b", "r_i"])
    return found.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
