"""Gradient-boosted trees for a yes / no question, over binned features, in numpy.

Trees are full and of equal depth, so a model is three arrays and scoring is a few gathers
for a whole batch of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class BoostedTrees:
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # go right if the value is larger
    leaf: np.ndarray  # (trees, leaves), log-odds
    start: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:  # all rows are at one depth
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner]
        return out


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2,
    ridge: float = 2.0,
) -> BoostedTrees:
    """Second-order boosting of the logistic loss; splits on quantile bins of each feature."""
    rows, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    score = np.full(rows, start)
    inner = 2**depth - 1
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaves = np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(rows, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = node - first
            g_all = np.bincount(at, gradient, count)
            h_all = np.bincount(at, weight, count)
            best = np.full(count, 1e-6)
            for j in range(width):
                if not len(edges[j]):
                    continue
                key = at * BINS + binned[:, j]
                g = np.bincount(key, gradient, count * BINS).reshape(count, BINS).cumsum(axis=1)
                h = np.bincount(key, weight, count * BINS).reshape(count, BINS).cumsum(axis=1)
                g_right, h_right = g_all[:, None] - g, h_all[:, None] - h
                gain = g**2 / (h + ridge) + g_right**2 / (h_right + ridge)
                gain -= (g_all**2 / (h_all + ridge))[:, None]
                gain[(h < 1) | (h_right < 1)] = 0
                cut = gain[:, : len(edges[j])].argmax(axis=1)
                top = gain[np.arange(count), cut]
                better = top > best
                best[better] = top[better]
                feature[t, first : first + count][better] = j
                threshold[t, first : first + count][better] = edges[j][cut[better]]
            node = 2 * node + 1 + (x[np.arange(rows), feature[t, node]] > threshold[t, node])
        g = np.bincount(node - inner, gradient, inner + 1)
        h = np.bincount(node - inner, weight, inner + 1)
        leaves[t] = rate * g / (h + ridge)
        score += leaves[t][node - inner]
    return BoostedTrees(feature, threshold, leaves, start)
