"""Gradient-boosted trees for two classes, on small samples, with arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Complete binary trees of one depth: per tree the feature and threshold of each inner node, and leaf values."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            while at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 24, ridge: float = 1.0) -> Boosted:
    """Fit to rows ``x`` with classes ``y`` (0, 1) by second-order boosting of the logistic loss."""
    y = y.astype(float)
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    score, inner = np.full(len(y), start), 2**depth - 1
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(y), dtype=np.int64)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            best = 1e-9
            if len(mine):
                total_g, total_h = g[mine].sum(), h[mine].sum()
                for f, cut in enumerate(cuts):
                    if not len(cut):
                        continue
                    b = binned[mine, f]
                    left_g = np.cumsum(np.bincount(b, g[mine], len(cut) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(b, h[mine], len(cut) + 1))[:-1]
                    right_g, right_h = total_g - left_g, total_h - left_h
                    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - total_g**2 / (total_h + ridge)
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, feature[node], threshold[node] = float(gain[k]), f, cut[k]
            at[mine] = 2 * node + 1 + (x[mine, feature[node]] > threshold[node])
        where = at - inner
        value = -rate * np.bincount(where, g, inner + 1) / (np.bincount(where, h, inner + 1) + ridge)
        score += value[where]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Boosted(start, np.array(features), np.array(thresholds), np.array(leaves))
