"""Gradient-boosted trees for two classes (logistic loss), on binned features."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Complete trees of one depth; arrays of (tree, inner node) and (tree, leaf)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 100, depth: int = 5,
                 rate: float = 0.25, penalty: float = 1.0, share_of_rows: float = 0.4):
        n, width = x.shape
        weight = np.ones(n) if weight is None else weight
        self.depth = depth
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1) if n else np.zeros((0, width), int)
        inner = 2 ** depth - 1
        self.feature, self.threshold = np.zeros((trees, inner), int), np.full((trees, inner), np.inf)
        self.leaf = np.zeros((trees, inner + 1))
        share = np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3) if n else 0.5
        self.start = float(np.log(share / (1 - share)))
        margin, drawn = np.full(n, self.start), np.random.RandomState(3)
        flat = binned + np.arange(width) * BINS
        for t in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = weight * (p - y), weight * p * (1 - p) + 1e-9
            used = drawn.rand(n) < share_of_rows      # each tree is grown on its own part of the rows
            at = np.zeros(n, int)
            for level in range(depth):
                for node in range(2 ** level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero((at == node) & used)
                    if len(rows) > 1:
                        self._split(t, node, flat[rows], g[rows], h[rows], width, cuts, penalty)
                go = self.threshold[t, at] < x[np.arange(n), self.feature[t, at]]
                at = 2 * at + 1 + go
            at -= inner
            up, down = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
            self.leaf[t] = -rate * up / (down + penalty)
            margin += self.leaf[t, at]

    def _split(self, t, node, flat, g, h, width, cuts, penalty):
        cells = flat.ravel()
        sums = [np.bincount(cells, np.repeat(v, width), width * BINS).reshape(width, BINS) for v in (g, h)]
        left_g, left_h = (s.cumsum(axis=1)[:, :-1] for s in sums)
        all_g, all_h = g.sum(), h.sum()
        gain = left_g ** 2 / (left_h + penalty) + (all_g - left_g) ** 2 / (all_h - left_h + penalty) - all_g ** 2 / (all_h + penalty)
        for f, c in enumerate(cuts):
            gain[f, len(c):] = -np.inf
        best = gain.argmax()
        f, b = divmod(int(best), BINS - 1)
        if gain[f, b] > 1e-6:
            self.feature[t, node], self.threshold[t, node] = f, cuts[f][b]

    def probability(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        rows, margin = np.arange(n), np.full(n, self.start)
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(n, int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (threshold[at] < x[rows, feature[at]])
            margin += leaf[at - (2 ** self.depth - 1)]
        return 1 / (1 + np.exp(-margin))
