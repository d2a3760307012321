"""Gradient-boosted trees for the logistic loss, on histograms of small feature matrices."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Binary classifier of depth-limited trees; deterministic, as it draws nothing at random."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: int = 8, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.base = 0.0
        self.trees: list[list[tuple[int, float, int, int, float]]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        self.base = float(np.log(mean / (1 - mean)))
        edges = [np.unique(np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1])) for column in x.T]
        coded = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)], axis=1)
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            tree: list[tuple[int, float, int, int, float]] = []

            def node(rows: np.ndarray, level: int) -> int:
                at = len(tree)
                g, h = grad[rows].sum(), hess[rows].sum()
                value = float(-self.rate * g / (h + self.ridge))
                tree.append((-1, 0.0, 0, 0, value))
                if level == self.depth or len(rows) < 2 * self.least:
                    return at
                best = (1e-6, -1, -1)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    code = coded[rows, f]
                    n = np.bincount(code, minlength=len(e) + 1).cumsum()[:-1]
                    gl = np.bincount(code, grad[rows], len(e) + 1).cumsum()[:-1]
                    hl = np.bincount(code, hess[rows], len(e) + 1).cumsum()[:-1]
                    gain = gl**2 / (hl + self.ridge) + (g - gl) ** 2 / (h - hl + self.ridge) - g**2 / (h + self.ridge)
                    gain[(n < self.least) | (len(rows) - n < self.least)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
                _, f, k = best
                if f < 0:
                    return at
                low = coded[rows, f] <= k
                left, right = node(rows[low], level + 1), node(rows[~low], level + 1)
                tree[at] = (f, float(edges[f][k]), left, right, value)
                return at

            node(np.arange(len(y)), 0)
            self.trees.append(tree)
            margin += self._values(tree, x)
        return self

    @staticmethod
    def _values(tree: list[tuple[int, float, int, int, float]], x: np.ndarray) -> np.ndarray:
        feature = np.array([t[0] for t in tree])
        cut, value = np.array([t[1] for t in tree]), np.array([t[4] for t in tree])
        left, right = np.array([t[2] for t in tree]), np.array([t[3] for t in tree])
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = feature[at]
            rows = np.flatnonzero(f >= 0)
            if not len(rows):
                return value[at]
            here = at[rows]
            at[rows] = np.where(x[rows, f[rows]] <= cut[here], left[here], right[here])

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        for tree in self.trees:
            margin += self._values(tree, x)
        return 1 / (1 + np.exp(-margin))
