"""Signature trees: a dual traversal that finds pairs of sets with enough in common.

A set is represented by its size and a bitmap with the bits its hashed tokens fall on. A node holds the OR of the bitmaps below, the
range of sizes, and the most tokens that any set below has beyond its bits. Of two nodes, no pair of sets below can
have more tokens in common than the nodes have bits, plus those spare tokens of one side; node pairs that cannot
reach the overlap the threshold asks of their smallest sets, or whose size ranges are too far apart, are left with all that
is below them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN = 8
SLAB = 1 << 21  # words compared at once


def width(n: int) -> int:
    """64-bit words of the bitmap of a set of ``n`` tokens: 2 to 4 bits a token, a power of two."""
    return max(1, 1 << max(0, (2 * int(n) - 1).bit_length() - 6))


def bitmap(tokens: np.ndarray) -> np.ndarray:
    words = width(len(tokens))
    out = np.zeros(words * 64, np.uint8)
    out[(tokens & np.uint64(words * 64 - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of ``words`` words from a wider one."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


class Tree:
    """Nodes level by level (leaves first), children in runs of ``FAN``; ``rows``: the leaves' rows, by size."""

    def __init__(self, rows: np.ndarray, bits: np.ndarray, sizes: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        self.rows = rows[order]
        n = sizes[order].astype(np.int64)
        level = (bits[order], n, n, n - np.bitwise_count(bits[order]).sum(axis=1, dtype=np.int64))
        self.levels = [level]
        while len(level[1]) > FAN:
            level = self._above(level)

    def _above(self, level):
        at = np.arange(0, len(level[1]), FAN)
        level = (np.bitwise_or.reduceat(level[0], at, axis=0), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at), np.maximum.reduceat(level[3], at))
        self.levels.append(level)
        return level

    def raise_to(self, height: int) -> None:
        while len(self.levels) < height:
            self._above(self.levels[-1])


def pairs(x: Tree, y: Tree | None, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs that may have a Jaccard similarity of ``num`` / ``den`` or more; ``y`` None: pairs within ``x``, each once."""
    own = y is None
    y = x if own else y
    height = max(len(x.levels), len(y.levels))
    x.raise_to(height), y.raise_to(height)
    top = np.stack(np.meshgrid(np.arange(len(x.levels[-1][1])), np.arange(len(y.levels[-1][1])), indexing="ij")).reshape(2, -1)
    stack = [(height - 1, *(top[:, top[0] <= top[1]] if own else top))]
    slab = max(256, SLAB // x.levels[0][0].shape[1])
    while stack:
        k, a, b = stack.pop()
        if len(a) > slab:
            stack += [(k, a[at: at + slab], b[at: at + slab]) for at in range(0, len(a), slab)]
            continue
        (xb, xl, xh, xs), (yb, yl, yh, ys) = x.levels[k], y.levels[k]
        near = (den * xh[a] >= num * yl[b]) & (den * yh[b] >= num * xl[a])
        if own and k == 0:
            near &= a < b
        a, b = a[near], b[near]
        most = np.bitwise_count(xb[a] & yb[b]).sum(axis=1, dtype=np.int64) + np.minimum(xs[a], ys[b])
        most = np.minimum(most, np.minimum(xh[a], yh[b]))
        near = (num + den) * most >= num * (xl[a] + yl[b])
        a, b = a[near], b[near]
        if not len(a):
            continue
        if k == 0:
            yield x.rows[a], y.rows[b]
            continue
        step = np.arange(FAN)
        c = np.broadcast_to((a * FAN)[:, None, None] + step[None, :, None], (len(a), FAN, FAN)).ravel()
        d = np.broadcast_to((b * FAN)[:, None, None] + step[None, None, :], (len(a), FAN, FAN)).ravel()
        inside = (c < len(x.levels[k - 1][1])) & (d < len(y.levels[k - 1][1]))
        if own:
            inside &= c <= d
        stack.append((k - 1, c[inside], d[inside]))


def candidates(bitmaps: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, right: np.ndarray | None, num: int, den: int):
    """Pairs between the rows ``left`` and ``right`` (None: within ``left``) of one unit. Sets whose sizes allow the threshold have bitmaps of one
    width or of twice it (thresholds of a half and more); the wider are folded."""
    words = np.array([len(b) for b in bitmaps])

    def tree(rows, w):
        return Tree(rows, np.stack([bitmaps[r] if words[r] == w else folded(bitmaps[r], w) for r in rows]), sizes[rows]) if len(rows) else None

    right_ = left if right is None else right
    for w in np.unique(words[np.concatenate([left, right_])]):
        a, b = left[words[left] == w], right_[words[right_] == w]
        wide_a, wide_b = left[words[left] == 2 * w], right_[words[right_] == 2 * w]
        if right is None:
            if len(a):
                t = tree(a, w)
                yield from pairs(t, None, num, den)
                if len(wide_a):
                    yield from pairs(t, tree(wide_a, w), num, den)
            continue
        for p, q in ((a, b), (a, wide_b), (wide_a, b)):
            if len(p) and len(q):
                yield from pairs(tree(p, w), tree(q, w), num, den)
