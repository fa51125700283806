"""Gradient-boosted trees for a handful of classes, in NumPy: histogram splits, softmax loss."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Multi-class boosted trees of fixed depth. Trees are complete, so a prediction is ``depth`` vectorised steps."""

    def __init__(self, classes: int, rounds: int = 25, depth: int = 4, bins: int = 32, rate: float = 0.3, penalty: float = 1.0, least: float = 2.0):
        self.classes, self.rounds, self.depth, self.bins, self.rate, self.penalty, self.least = classes, rounds, depth, bins, rate, penalty, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, f = x.shape
        self.cuts = [np.unique(np.quantile(np.unique(x[:, j]), np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)
        score = np.zeros((n, self.classes))
        target = np.eye(self.classes)[y]
        for _ in range(self.rounds):
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for k in range(self.classes):
                g, h = p[:, k] - target[:, k], np.maximum(p[:, k] * (1 - p[:, k]), 1e-6)
                tree, out = self._grow(binned, g, h)
                self.trees.append(tree)
                score[:, k] += out
        return self

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray):
        n, f = binned.shape
        inner = 2**self.depth - 1
        feature, at, leaf = np.zeros(inner, np.int64), np.full(inner, self.bins, np.int64), np.zeros(2**self.depth)
        node = np.zeros(n, np.int64)
        flat = binned + np.arange(f) * self.bins
        for level in range(self.depth):
            width, first = 2**level, 2**level - 1
            key = ((node - first)[:, None] * (f * self.bins) + flat).ravel()
            size = width * f * self.bins
            sums = [np.bincount(key, np.repeat(v, f), size).reshape(width, f, self.bins).cumsum(2) for v in (g, h)]
            gl, hl = sums
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + self.penalty) + (gt - gl) ** 2 / (ht - hl + self.penalty) - gt**2 / (ht + self.penalty)
            gain[(hl < self.least * 1e-3) | (ht - hl < self.least * 1e-3)] = 0
            best = gain.reshape(width, -1).argmax(1)
            useful = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            feature[first : first + width] = np.where(useful, best // self.bins, 0)
            at[first : first + width] = np.where(useful, best % self.bins, self.bins)
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > at[node])
        where = node - inner
        gs, hs = np.bincount(where, g, 2**self.depth), np.bincount(where, h, 2**self.depth)
        leaf = -self.rate * gs / (hs + self.penalty)
        cut = np.array([self.cuts[j][a] if a < len(self.cuts[j]) else np.inf for j, a in zip(feature, at)])
        return (feature, cut, leaf), leaf[where]

    def log_proba(self, x: np.ndarray) -> np.ndarray:
        score = np.zeros((len(x), self.classes))
        if not len(x):
            return score
        rows, inner = np.arange(len(x)), 2**self.depth - 1
        for i, (feature, cut, leaf) in enumerate(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            score[:, i % self.classes] += leaf[node - inner]
        score -= score.max(1, keepdims=True)
        return score - np.log(np.exp(score).sum(1, keepdims=True))
