"""Vectorised byte and code-point kernels shared by the operators of this subpackage.

Every kernel works on a whole Arrow string column at once: texts are laid end to end in one
buffer, and words, lines or runs are found as (start, end) segments of that buffer, so the cost
per character is a handful of numpy instructions and no Python object is made per word.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa

U64 = np.uint64
_MASK = (1 << 64) - 1


def string_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class SegmentHash:
    """64-bit hashes of arbitrary segments of one buffer, from prefix sums of a rolling polynomial.

    Symbols are replaced by pseudo-random words; hash(s, e) = mix(sum of word[i] * B^(e-i) + length).
    """

    def __init__(self, symbols: np.ndarray, seed: int = 1):
        base = (0x9E3779B97F4A7C15 * (2 * seed + 1) | 1) & _MASK
        n = len(symbols)
        if symbols.dtype == np.uint8:
            table = mix64(np.arange(256, dtype=U64) + U64(257 * seed + 1))
            words = table[symbols]
        else:
            words = mix64(symbols.astype(U64) + U64(257 * seed + 1))
        inv = pow(base, -1, 1 << 64)
        self._pow = _powers(base, n + 1)
        self._pre = np.zeros(n + 1, U64)
        np.cumsum(words * _powers(inv, n), out=self._pre[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        d = (self._pre[end] - self._pre[start]) * self._pow[start]
        return mix64(d + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


_POW: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for reuse."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.cumprod(have, dtype=U64)
        _POW[base] = have
        if len(_POW) > 8:
            _POW.pop(next(iter(_POW)))
    return have[:n]


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start[i], start[i] + count[i])."""
    total = int(count.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(total, dtype=np.int64)


def same_segments(symbols: np.ndarray, s1: np.ndarray, s2: np.ndarray, length: np.ndarray) -> bool:
    """True when symbols[s1:s1+length] equals symbols[s2:s2+length] for every row."""
    idx = ranges(s1, length)
    return bool(np.array_equal(symbols[idx], symbols[idx + np.repeat(s2 - s1, length)]))


def distinct_segments(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each segment, index of a representative of each code); exact, hashes are verified."""
    length = end - start
    for seed in range(1, 9):
        codes, _ = pd.factorize(SegmentHash(symbols, seed)(start, end))
        n = int(codes.max()) + 1 if len(codes) else 0
        rep = np.zeros(n, np.int64)
        rep[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        r = rep[codes]
        if np.array_equal(length, length[r]) and same_segments(symbols, start, start[r], length):
            return codes, rep
    raise RuntimeError("segment hashes collide under every seed")


# --- words of the retrieval tokenizer: runs of ASCII letters and digits, lower-cased -------------

_ALNUM = np.zeros(256, bool)
for _r in ((48, 58), (65, 91), (97, 123)):
    _ALNUM[_r[0] : _r[1]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ascii_words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, first word of each text with a closing total)."""
    is_word = _ALNUM[raw]
    padded = np.zeros(len(raw) + 1, np.int8)
    padded[: len(raw)] = is_word
    step = np.diff(padded, prepend=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    inner = cuts[is_word[cuts] & is_word[cuts - 1]] if len(cuts) else cuts
    if len(inner):  # a word may not run over the border of two texts
        inner = np.unique(inner)
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    return _LOWER[raw], starts, ends, np.searchsorted(starts, off)


def shingles(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, first shingle of each text with a closing total) of `width` successive words."""
    low, s, e, first = ascii_words(raw, off)
    words = SegmentHash(low)(s, e)
    n = np.diff(first)
    count = np.maximum(n - width + 1, 0)
    if len(words) < width:
        return np.zeros(0, U64), np.concatenate([[0], np.cumsum(count)])
    roll = np.zeros(len(words) - width + 1, U64)
    for k in range(width):
        roll = roll * U64(0x2545F4914F6CDD1D) + words[k : len(words) - width + 1 + k]
    keep = ranges(first[:-1], count)
    return mix64(roll[keep]), np.concatenate([[0], np.cumsum(count)])


def distinct_per_row(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row of a ragged array, and the new row borders."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[keep], np.concatenate([[0], np.cumsum(np.bincount(r[keep], minlength=len(first) - 1))])


# --- code points -------------------------------------------------------------------------------


def code_points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts end to end, text borders); nulls are empty."""
    raw, off = string_buffer(col)
    text = raw.tobytes().decode("utf-8", "replace")
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cps) == len(raw):
        return cps, off
    lead = (raw & 0xC0) != 0x80
    if int(lead.sum()) == len(cps):
        before = np.concatenate([[0], np.cumsum(lead)])
        return cps, before[off]
    parts = ["" if x is None else x for x in col.to_pylist()]
    return (
        np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32),
        np.concatenate([[0], np.cumsum([len(p) for p in parts])]),
    )


#: Code points with the Unicode property White_Space.
WHITE_SPACE = (
    [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
_CLASSES: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, other or white space."""
    if not _CLASSES:
        kinds = {"L": LETTER, "N": NUMBER}
        t = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        t[WHITE_SPACE] = SPACE
        _CLASSES.append(t)
    return _CLASSES[0]


def strings_from_code_points(cps: np.ndarray, off: np.ndarray) -> list[str]:
    """Texts given by code points and borders."""
    text = cps.astype("<u4").tobytes().decode("utf-32-le", "replace")
    return [text[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
