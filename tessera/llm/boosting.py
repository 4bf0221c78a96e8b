"""Gradient-boosted trees on a bounded sample, and the same trees as a Spark expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: str
    cut: float  # up to and including it to the left
    left: Split | Leaf
    right: Split | Leaf


@dataclass(frozen=True)
class Boosted:
    base: float
    trees: tuple

    def margin(self, x: dict[str, np.ndarray]) -> np.ndarray:
        def walk(t):
            return t.value if isinstance(t, Leaf) else np.where(x[t.feature] <= t.cut, walk(t.left), walk(t.right))

        n = len(next(iter(x.values())))
        return self.base + sum((np.broadcast_to(walk(t), n) for t in self.trees), np.zeros(n))

    def score(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))

    def column(self, x: dict[str, Column]) -> Column:
        def walk(t):
            return F.lit(t.value) if isinstance(t, Leaf) else F.when(x[t.feature] <= t.cut, walk(t.left)).otherwise(walk(t.right))

        total = F.lit(self.base)
        for t in self.trees:
            total = total + walk(t)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(x: dict[str, np.ndarray], y: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, least: float = 5.0) -> Boosted:
    """Newton boosting of the log-loss; cuts lie midway between neighbouring values. Same rows, same trees."""
    names = sorted(x)
    p0 = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(p0 / (1 - p0)))
    margin, trees = np.full(len(y), base), []

    def grow(rows, g, h, level):
        leaf = Leaf(float(-rate * g[rows].sum() / (h[rows].sum() + ridge)))
        if level == 0 or len(rows) < 2 * least:
            return leaf
        here, best = g[rows].sum() ** 2 / (h[rows].sum() + ridge), (1e-6, None, None)
        for name in names:
            values, where = np.unique(x[name][rows], return_inverse=True)
            if len(values) < 2:
                continue
            gs, hs, ns = (np.cumsum(np.bincount(where, weights=w))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = gs ** 2 / (hs + ridge) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + ridge) - here
            gain[(ns < least) | (len(rows) - ns < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], name, (values[k] + values[k + 1]) / 2)
        if best[1] is None:
            return leaf
        left = x[best[1]][rows] <= best[2]
        return Split(best[1], float(best[2]), grow(rows[left], g, h, level - 1), grow(rows[~left], g, h, level - 1))

    for _ in range(rounds if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(y)), p - y, p * (1 - p), depth)
        trees.append(tree)
        margin = margin + Boosted(0.0, (tree,)).margin(x)
    return Boosted(base, tuple(trees))
