"""Vantage-point trees over bit fingerprints: one tree with batched range queries, and self-joins of many small trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import kernels as K

LEAF = 48
#: Points of a leaf of a forest's trees, and pairs that are compared at once.
TWIG = 4
_AT_ONCE = 1 << 19


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints given as rows of 64-bit words (broadcasting over rows)."""
    d = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16)
    for k in range(1, a.shape[-1]):
        d += np.bitwise_count(a[..., k] ^ b[..., k])
    return d


class VPTree:
    """Each inner node splits its points by the median distance to a vantage point.

    A child keeps the least and the greatest distance of its points to the vantage point, so a
    query at distance d with radius r skips it when d + r < least or d - r > greatest, by the
    triangle inequality.
    """

    def __init__(self, points: np.ndarray, seed: int = 7):
        self.points = points
        self._rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)))

    def _build(self, own: np.ndarray) -> tuple:
        if len(own) <= LEAF:
            return (None, own)
        at = int(self._rng.integers(len(own)))
        v, rest = own[at], np.delete(own, at)
        d = hamming(self.points[rest], self.points[v][None, :])
        order = np.argsort(d, kind="stable")
        d, rest = d[order], rest[order]
        half = len(rest) // 2
        near, far = rest[:half], rest[half:]
        return (
            v,
            (int(d[0]), int(d[half - 1]), self._build(near)),
            (int(d[half]), int(d[-1]), self._build(far)),
        )

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query rows, point rows) at distance `radius` or less, in pieces."""
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, q = stack.pop()
            if not len(q):
                continue
            if node[0] is None:
                own = node[1]
                for lo in range(0, len(q), 4096):
                    part = q[lo : lo + 4096]
                    i, j = np.nonzero(hamming(queries[part][:, None, :], self.points[own][None, :, :]) <= radius)
                    if len(i):
                        yield part[i], own[j]
                continue
            v, *children = node
            d = hamming(queries[q], self.points[v][None, :])
            hit = q[d <= radius]
            if len(hit):
                yield hit, np.full(len(hit), v)
            for least, greatest, child in children:
                stack.append((child, q[(d + radius >= least) & (d - radius <= greatest)]))


class Forest:
    """Pairs within a radius in each of many groups of points, by a vantage-point tree for each group.

    All trees grow together, a level at a time.  An inner node takes a vantage point, sorts its other
    points by their distance to it and splits them at the widest gap.  A point at distance d of the
    near side is compared with those points of the far side that lie at d + radius or less: by the
    triangle inequality the others are beyond the radius.  Both sides are nodes of the next level.
    """

    def __init__(self, points: np.ndarray, radius: int):
        self.points, self.radius = points, radius
        self.compared = 0
        self._left: list[np.ndarray] = []
        self._right: list[np.ndarray] = []

    def _compare(self, one: np.ndarray, first: np.ndarray, count: np.ndarray, order: np.ndarray) -> None:
        """Compare each point of `one` with `count` points of the order from `first` on."""
        upto = np.concatenate([[0], np.cumsum(count)])
        i = 0
        while i < len(one):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + _AT_ONCE, "right")) - 1)
            a, b = np.repeat(one[i:j], count[i:j]), order[K.ranges(first[i:j], count[i:j])]
            self._keep(a, b, hamming(self.points[a], self.points[b]))
            i = j

    def _keep(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        self.compared += len(d)
        near = d <= self.radius
        self._left.append(a[near])
        self._right.append(b[near])

    def pairs(self, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of points of the groups given by where they start and how long they are."""
        order = np.arange(len(self.points))
        while True:
            some = length > 1
            start, length = start[some], length[some]
            twig = length <= TWIG
            at = K.ranges(start[twig], length[twig] - 1)
            self._compare(order[at], at + 1, np.repeat((start + length)[twig], length[twig] - 1) - at - 1, order)
            start, length = start[~twig], length[~twig]
            if not len(start):
                break
            v, size = order[start], length - 1
            at = K.ranges(start + 1, size)
            node = np.repeat(np.arange(len(start)), size)
            d = hamming(self.points[order[at]], self.points[v[node]]).astype(np.int64)
            self._keep(v[node], order[at], d)
            key = node * 65536 + d
            by = np.argsort(key, kind="stable")
            key, d = key[by], d[by]
            order[at] = order[at][by]
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            gap = np.diff(d, prepend=0)
            gap[first] = -1
            widest = np.flatnonzero(gap == np.maximum.reduceat(gap, first)[node])
            cut = widest[np.unique(node[widest], return_index=True)[1]]  # the far side begins here
            near = np.flatnonzero(np.arange(len(d)) < cut[node])
            last = np.searchsorted(key, key[near] + self.radius, "right")
            last = np.minimum(last, (first + size)[node[near]])
            here = start + 1 - first  # from places among the sorted points to places in the order
            far = cut[node[near]]
            self._compare(order[at[near]], far + here[node[near]], np.maximum(last - far, 0), order)
            start = np.concatenate([start + 1, cut + here])
            length = np.concatenate([cut - first, first + size - cut])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *self._left]), np.concatenate([none, *self._right])
