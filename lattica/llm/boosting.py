"""Gradient-boosted trees on binned dense features, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: the centres and means of the blocks of the best non-decreasing fit of y over x."""
    blocks: list[list[float]] = []  # weight, weighted sum of y, weighted sum of x
    for i in np.argsort(x, kind="stable").tolist():
        blocks.append([w[i], w[i] * y[i], w[i] * x[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 2] / b[:, 0], b[:, 1] / b[:, 0]


class BoostedTrees:
    """Logistic loss, trees of a fixed depth over quantile bins. Fitting the same rows gives the same trees."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, smoothing: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.smoothing = rounds, depth, rate, bins, smoothing

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> BoostedTrees:
        shares = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, f], shares)) for f in range(x.shape[1])]
        # rare values matter here: where most rows are 0, the bins above 0 come from the others
        for f, cuts in enumerate(self.cuts):
            some = x[x[:, f] > 0, f]
            if len(some):
                self.cuts[f] = np.unique(np.concatenate([cuts, [0.0], np.quantile(some, shares[::4])]))
        binned = self._binned(x)
        positive = np.clip((w * y).sum() / w.sum(), 1e-6, 1 - 1e-6)
        self.base, self.trees = float(np.log(positive / (1 - positive))), []
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree, at = self._tree(binned, w * (y - p), w * np.maximum(p * (1 - p), 1e-9))
            self.trees.append(tree)
            margin += tree[2][at]
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1)

    def _tree(self, binned: np.ndarray, gradient: np.ndarray, curvature: np.ndarray):
        """A full binary tree as (features, bins, leaf values); a node without a useful split sends all rows left."""
        features, limits, node = [], [], np.zeros(len(gradient), np.int64)
        width = max(len(c) for c in self.cuts) + 1
        for level in range(self.depth):
            nodes = 1 << level
            best, choice, limit = np.full(nodes, 1e-9), np.zeros(nodes, np.int64), np.full(nodes, width, np.int64)
            for f in range(binned.shape[1]):
                key = node * width + binned[:, f]
                g = np.bincount(key, gradient, nodes * width).reshape(nodes, width).cumsum(axis=1)
                h = np.bincount(key, curvature, nodes * width).reshape(nodes, width).cumsum(axis=1)
                value = lambda a, b: a * a / (b + self.smoothing)
                gain = value(g, h) + value(g[:, -1:] - g, h[:, -1:] - h) - value(g[:, -1:], h[:, -1:])
                at = gain.argmax(axis=1)
                better = gain[np.arange(nodes), at] > best
                best[better], choice[better], limit[better] = gain[np.arange(nodes), at][better], f, at[better]
            features.append(choice)
            limits.append(limit)
            node = 2 * node + (binned[np.arange(len(node)), choice[node]] > limit[node])
        leaves = 1 << self.depth
        total, weight = np.bincount(node, gradient, leaves), np.bincount(node, curvature, leaves)
        return (features, limits, self.rate * total / (weight + self.smoothing)), node

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self._binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for features, limits, values in self.trees:
            node = np.zeros(len(x), np.int64)
            for choice, limit in zip(features, limits, strict=True):
                node = 2 * node + (binned[rows, choice[node]] > limit[node])
            out += values[node]
        return out
