"""Gradient-boosted trees for several classes, in numpy: histograms, complete trees of fixed depth, softmax loss."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, classes: int, rounds: int = 30, depth: int = 4, rate: float = 0.25, bins: int = 32, least: float = 2.0, ridge: float = 1.0):
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = classes, rounds, depth, rate, bins, least, ridge
        self.trees: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, f = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]).astype(np.int64)
        slots = binned + np.arange(f) * self.bins
        share = (np.bincount(y, minlength=self.classes) + 1.0) / (n + self.classes)
        self.start = np.log(share)
        score = np.tile(self.start, (n, 1))
        onehot = np.eye(self.classes)[y]
        for _ in range(self.rounds):
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for k in range(self.classes):
                tree = self._tree(slots, binned, cuts, p[:, k] - onehot[:, k], p[:, k] * (1 - p[:, k]) + 1e-6)
                self.trees.append((k, *tree))
                score[:, k] += self._leaves(x, tree)
        return self

    def _tree(self, slots: np.ndarray, binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, f = slots.shape
        width = f * self.bins
        feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(self.depth):
            count, base = 2**level, 2**level - 1
            flat = (slots + at[:, None] * width).ravel()
            gs = np.bincount(flat, np.repeat(g, f), count * width).reshape(count, f, self.bins).cumsum(2)
            hs = np.bincount(flat, np.repeat(h, f), count * width).reshape(count, f, self.bins).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
            gain[(hs < self.least) | (ht - hs < self.least)] = 0
            for node in range(count):
                j, b = np.unravel_index(gain[node].argmax(), gain[node].shape)
                if gain[node, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[base + node], cut[base + node] = j, cuts[j][b]
            at = 2 * at + (self._values(binned, cuts, feature[base + at], cut[base + at]))
        total_g, total_h = np.bincount(at, g, 2**self.depth), np.bincount(at, h, 2**self.depth)
        return feature, cut, -self.rate * total_g / (total_h + self.ridge)

    @staticmethod
    def _values(binned: np.ndarray, cuts: list[np.ndarray], feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        own = binned[np.arange(len(binned)), feature]
        pairs, back = np.unique(np.column_stack([feature, cut]), axis=0, return_inverse=True)
        at = np.array([np.iinfo(np.int64).max if np.isinf(c) else int(np.searchsorted(cuts[int(j)], c)) for j, c in pairs])
        return (own > at[back.ravel()]).astype(np.int64)

    def _leaves(self, x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, leaf = tree
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
        return leaf[at - len(feature)]

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        score = np.tile(self.start, (len(x), 1))
        for k, *tree in self.trees:
            score[:, k] += self._leaves(x, tuple(tree))
        top = score.max(1, keepdims=True)
        return score - top - np.log(np.exp(score - top).sum(1, keepdims=True))
