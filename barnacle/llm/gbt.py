"""Gradient-boosted trees with monotonic constraints, held as numpy node arrays.

Features are binned by quantiles; each tree is grown level by level from gradient histograms. A split on a constrained feature is
allowed only if the two values are in its direction within the node's bounds, and the middle of them then bounds
both subtrees, so a prediction is monotonic in that feature. Scoring walks all rows down a tree at once.
"""

from __future__ import annotations

import numpy as np


class Trees:
    def __init__(self, monotone: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 5.0, least: int = 20):
        self.monotone = np.array(monotone)
        self.trees, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least
        n = 2 ** (depth + 1) - 1
        # node i has the children 2i+1 and 2i+2; feature -1: a leaf
        self.feature, self.threshold, self.value = np.full((trees, n), -1, np.int32), np.zeros((trees, n)), np.zeros((trees, n))
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """x without NaN; y of 0 and 1."""
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            score += self._grow(t, binned, edges, p - y, p * (1 - p))
        return self

    def _grow(self, t: int, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> np.ndarray:
        n_nodes = self.feature.shape[1]
        at, bounds = np.zeros(len(g), np.int64), {0: (-np.inf, np.inf)}
        leaf = lambda sg, sh: -sg / (sh + self.l2)
        for level in range(self.depth + 1):
            for node in range(2**level - 1, min(2 ** (level + 1) - 1, n_nodes)):
                if node not in bounds:
                    continue
                rows, (lo, hi) = np.flatnonzero(at == node), bounds[node]
                sg, sh = g[rows].sum(), h[rows].sum()
                self.value[t, node] = self.rate * np.clip(leaf(sg, sh), lo, hi)
                best = (1e-6, -1, 0, 0.0, 0.0)
                for f in range(binned.shape[1]) if level < self.depth and len(rows) >= 2 * self.least else ():
                    b = binned[rows, f]
                    k = len(edges[f]) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, k))[:-1] for w in (g[rows], h[rows], None))
                    left, right = (np.clip(leaf(a, c), lo, hi) for a, c in ((gl, hl), (sg - gl, sh - hl)))
                    # gain of a value v over a node: -(G v + (H + l2) v^2 / 2)
                    gain = -(gl * left + (hl + self.l2) * left**2 / 2) - ((sg - gl) * right + (sh - hl + self.l2) * right**2 / 2)
                    v = np.clip(leaf(sg, sh), lo, hi)
                    gain += sg * v + (sh + self.l2) * v**2 / 2
                    gain[(nl < self.least) | (len(rows) - nl < self.least) | ((right - left) * self.monotone[f] < 0)] = 0
                    if len(gain) and gain.max() > best[0]:
                        i = int(gain.argmax())
                        best = (float(gain[i]), f, i, float(left[i]), float(right[i]))
                _, f, i, left, right = best
                if f >= 0:
                    self.feature[t, node], self.threshold[t, node] = f, edges[f][i]
                    goes = binned[rows, f] > i
                    at[rows] = 2 * node + 1 + goes
                    middle, way = (left + right) / 2, self.monotone[f]
                    bounds[2 * node + 1] = (lo, min(hi, middle)) if way > 0 else (max(lo, middle), hi) if way < 0 else (lo, hi)
                    bounds[2 * node + 2] = (max(lo, middle), hi) if way > 0 else (lo, min(hi, middle)) if way < 0 else (lo, hi)
        return self.value[t, at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f >= 0, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > threshold[at]), at)
            score += value[at]
        return 1 / (1 + np.exp(-score))
