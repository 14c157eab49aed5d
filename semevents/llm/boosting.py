"""Histogram gradient-boosted trees in numpy: bounded training data on the driver, flat arrays for scoring."""

from __future__ import annotations

import numpy as np


class Boosted:
    """A forest as flat arrays. Node i of a tree goes to 2i+1 if x[feature] <= threshold, else to 2i+2."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, base: float, depth: int):
        self.feature, self.threshold, self.value, self.base, self.depth = feature, threshold, value, base, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for the rows of x: all rows go down all trees together, a level at a time."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 2 - (x[rows, f[at]] <= t[at])
            total += v[at]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Boosted:
    """Logistic boosting over quantile bins; every tree is full, cut nodes that gain nothing send all rows left."""
    n, d = x.shape
    nodes = 2 ** (depth + 1) - 1
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if n else np.empty(0) for j in range(d)]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1) if n else np.empty((0, d), np.int64)
    p = np.clip((y.sum() + 1) / (n + 2), 1e-6, 1 - 1e-6)
    base = float(np.log(p / (1 - p)))
    raw = np.full(n, base)
    feature, threshold, value = (np.zeros((trees, nodes), k) for k in (np.int64, float, float))
    threshold[:] = np.inf
    wide = bins + 1
    column = np.arange(d) * wide
    for k in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        g, h = prob - y, prob * (1 - prob)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            cell = ((at - first)[:, None] * (d * wide) + column + code).ravel()
            hist = lambda w: np.bincount(cell, weights=np.repeat(w, d), minlength=count * d * wide).reshape(count, d, wide)  # noqa: B023, E731
            gl, hl = np.cumsum(hist(g), axis=2), np.cumsum(hist(h), axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = -1
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -1
            best = gain.reshape(count, -1).argmax(axis=1)
            for c, b in enumerate(best):
                j, cut = divmod(int(b), wide)
                if gain[c, j, cut] > 1e-9:
                    feature[k, first + c], threshold[k, first + c] = j, edges[j][cut]
            f, t = feature[k][at], threshold[k][at]
            at = 2 * at + 2 - (x[np.arange(n), f] <= t)
        leaf = at
        gs, hs = np.bincount(leaf, weights=g, minlength=nodes), np.bincount(leaf, weights=h, minlength=nodes)
        value[k] = -rate * gs / (hs + l2)
        raw += value[k][leaf]
    return Boosted(feature, threshold, value, base, depth)
