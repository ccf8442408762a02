"""Gradient-boosted trees for two classes, on binned features. Fits on a bounded sample; scores arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 16


@dataclass(frozen=True)
class Trees:
    """Complete trees: ``feature`` and ``limit`` of the inner nodes and ``leaf`` values, one row a tree."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    base: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += leaf[node - (leaf.shape[0] - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 40, depth: int = 4, rate: float = 0.3, ridge: float = 1.0, weight: np.ndarray | None = None) -> Trees:
    n, width = x.shape
    weight = np.ones(n) if weight is None else weight
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    flat = binned + np.arange(width) * BINS
    share = np.clip((weight * y).sum() / weight.sum(), 0.01, 0.99)
    base = float(np.log(share / (1 - share)))
    logit = np.full(n, base)
    features, limits, leaves = [], [], []
    inner = (1 << depth) - 1
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-logit))
        grad, hess = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * width * BINS + flat).ravel()
            shape = (count, width, BINS)
            g = np.bincount(at, np.repeat(grad, width), count * width * BINS).reshape(shape)
            h = np.bincount(at, np.repeat(hess, width), count * width * BINS).reshape(shape)
            gl, hl = g.cumsum(2)[:, :, :-1], h.cumsum(2)[:, :, :-1]
            gt, ht = g.sum(2, keepdims=True), h.sum(2, keepdims=True)
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            best = gain.reshape(count, -1).argmax(1)
            f, b = best // (BINS - 1), best % (BINS - 1)
            for k in range(count):
                if gain[k, f[k], b[k]] > 1e-6 and b[k] < len(edges[f[k]]):
                    feature[first + k], limit[first + k] = f[k], edges[f[k]][b[k]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > limit[node])
        place = node - inner
        g, h = np.bincount(place, grad, inner + 1), np.bincount(place, hess, inner + 1)
        leaf = rate * g / (h + ridge)
        logit += leaf[place]
        features.append(feature)
        limits.append(limit)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(limits), np.array(leaves), base)
