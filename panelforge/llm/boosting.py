"""Gradient-boosted trees for two classes, in numpy, on binned features."""

from __future__ import annotations

import numpy as np


class Trees:
    """Logistic boosting with trees of a fixed depth and second-order leaf values."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, d = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        code = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)], axis=1)
        self.base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        f = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            size = 2**self.depth - 1
            feature, value = np.zeros(size, np.int64), np.full(size, np.inf)
            leaf = np.zeros(2**self.depth)
            node = np.zeros(n, np.int64)  # within its level
            for level in range(self.depth):
                first = 2**level - 1
                best = np.zeros(2**level)
                for j in range(d):
                    if not len(cuts[j]):
                        continue
                    width = len(cuts[j]) + 1
                    key = node * width + code[:, j]
                    gs = np.bincount(key, g, 2**level * width).reshape(-1, width).cumsum(axis=1)
                    hs = np.bincount(key, h, 2**level * width).reshape(-1, width).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    at = gain[:, :-1].argmax(axis=1)
                    top = gain[np.arange(len(at)), at]
                    for k in np.flatnonzero(top > best + 1e-9).tolist():
                        best[k] = top[k]
                        feature[first + k], value[first + k] = j, cuts[j][at[k]]
                node = node * 2 + (x[np.arange(n), feature[first + node]] >= value[first + node])
            gs, hs = np.bincount(node, g, len(leaf)), np.bincount(node, h, len(leaf))
            leaf = self.rate * gs / (hs + self.ridge)
            f += leaf[node]
            self.trees.append((feature, value, leaf))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the second class."""
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, value, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                node = node * 2 + (x[rows, feature[first + node]] >= value[first + node])
            f += leaf[node]
        return f
