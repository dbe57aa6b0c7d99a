"""Gradient-boosted regression trees for two classes, in numpy: logistic loss, histogram splits, fixed depth."""

from __future__ import annotations

import numpy as np


class Trees:
    """Complete binary trees of one depth, stored as arrays: split feature, threshold (go right if x > threshold) and leaf value."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, bias: float) -> None:
        self.feature, self.threshold, self.value, self.bias = feature, threshold, value, float(bias)
        self.depth = int(np.log2(value.shape[1]))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log odds per row."""
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2**self.depth - 1)]
        return out

    def save(self, path: str) -> None:
        np.savez_compressed(path, feature=self.feature.astype(np.int16), threshold=self.threshold.astype(np.float32), value=self.value.astype(np.float32), bias=self.bias)

    @staticmethod
    def load(path: str) -> Trees:
        with np.load(path) as z:
            return Trees(z["feature"].astype(np.int64), z["threshold"].astype(float), z["value"].astype(float), float(z["bias"]))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Trees:
    n, d = x.shape
    # Features of few values are cut between them, so that a rare value of a flag can be told apart.
    values = [np.unique(x[:, j]) for j in range(d)]
    cuts = [(v[1:] + v[:-1]) / 2 if len(v) <= bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j, v in enumerate(values)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = np.log(p0 / (1 - p0))
    score = np.full(n, bias)
    inner = 2**depth - 1
    feature, threshold, value = np.zeros((rounds, inner), int), np.full((rounds, inner), np.inf), np.zeros((rounds, inner + 1))
    for r in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best = np.full(count, 1e-6)
            total_g, total_h = np.bincount(local, g, count), np.bincount(local, h, count)
            for j in range(d):
                k = len(cuts[j])
                if not k:
                    continue
                key = local * (k + 1) + binned[:, j]
                cg = np.cumsum(np.bincount(key, g, count * (k + 1)).reshape(count, k + 1), 1)[:, :-1]
                ch = np.cumsum(np.bincount(key, h, count * (k + 1)).reshape(count, k + 1), 1)[:, :-1]
                rg, rh = total_g[:, None] - cg, total_h[:, None] - ch
                gain = cg**2 / (ch + ridge) + rg**2 / (rh + ridge) - (total_g**2 / (total_h + ridge))[:, None]
                at = gain.argmax(1)
                top = gain[np.arange(count), at]
                for q in np.flatnonzero(top > best):
                    best[q] = top[q]
                    feature[r, first + q], threshold[r, first + q] = j, cuts[j][at[q]]
            node = 2 * node + 1 + (x[np.arange(n), feature[r, node]] > threshold[r, node])
        leaf = node - inner
        value[r] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        score += value[r, leaf]
    return Trees(feature, threshold, value, bias)
