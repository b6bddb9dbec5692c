"""Gradient-boosted trees for a yes-no question over small whole-number features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Trees of fixed depth, as arrays: node i has children 2 i + 1 and 2 i + 2; leaves stand after the inner nodes."""

    depth: int = 3
    base: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def _leaf(self, x: np.ndarray, f: np.ndarray, c: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > c[node])
        return node - (2**self.depth - 1)

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = 40, rate: float = 0.3, ridge: float = 1.0) -> BoostedTrees:
        """Newton steps on the logistic loss; each level takes every node's best split over all features and values."""
        bins = int(x.max(initial=0)) + 1
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        z = np.full(len(y), self.base)
        for _ in range(trees):
            q = 1 / (1 + np.exp(-z))
            g, h = y - q, np.maximum(q * (1 - q), 1e-6)
            inner = 2**self.depth - 1
            f, c = np.zeros(inner, np.int64), np.full(inner, bins, np.int64)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.zeros(width)
                for j in range(x.shape[1]):
                    key = (node - first) * bins + x[:, j]
                    gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)
                    hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                    k = gain.argmax(1)
                    top = gain[np.arange(width), k]
                    better = top > best + 1e-9
                    best = np.where(better, top, best)
                    f[first : first + width][better] = j
                    c[first : first + width][better] = k[better]
                node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > c[node])
            leaf = node - inner
            value = rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + ridge)
            z += value[leaf]
            self.features.append(f)
            self.cuts.append(c)
            self.leaves.append(value)
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, c, v in zip(self.features, self.cuts, self.leaves):
            z += v[self._leaf(x, f, c)]
        return z
