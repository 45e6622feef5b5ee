"""Gradient-boosted trees of fixed depth for a binary label, with Platt calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEPTH, ROUNDS, RATE, BINS, RIDGE = 3, 40, 0.3, 32, 1.0


@dataclass
class Boosted:
    #: For each tree: the features and thresholds of its inner nodes in level order, and its leaf values.
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray
    start: float
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**DEPTH - 1)]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.raw(x) + self.offset)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on rows that weren't trained on, by Newton steps."""
        z = self.raw(x)
        a = np.stack([z, np.ones_like(z)], axis=1)
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        w = np.array([1.0, 0.0])
        for _ in range(20):
            p = _sigmoid(a @ w)
            hessian = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
            w -= np.linalg.solve(hessian, a.T @ (p - target) + 1e-3 * (w - [1.0, 0.0]))
        self.slope, self.offset = float(w[0]), float(w[1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Boosted:
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    start = float(np.log(mean / (1 - mean)))
    z = np.full(n, start)
    inner, ends = 2**DEPTH - 1, 2**DEPTH
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        p = _sigmoid(z)
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-6)
            cell_g, cell_h = np.bincount(node - first, g, count), np.bincount(node - first, h, count)
            base = cell_g**2 / (cell_h + RIDGE)
            for j in range(d):
                if not len(edges[j]):
                    continue
                key = (node - first) * (BINS + 1) + binned[:, j]
                lg = np.bincount(key, g, count * (BINS + 1)).reshape(count, -1).cumsum(1)[:, : len(edges[j])]
                lh = np.bincount(key, h, count * (BINS + 1)).reshape(count, -1).cumsum(1)[:, : len(edges[j])]
                gain = lg**2 / (lh + RIDGE) + (cell_g[:, None] - lg) ** 2 / (cell_h[:, None] - lh + RIDGE) - base[:, None]
                at = gain.argmax(1)
                for k in range(count):
                    if gain[k, at[k]] > best[k]:
                        best[k], f[first + k], t[first + k] = gain[k, at[k]], j, edges[j][at[k]]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, ends) / (np.bincount(leaf, h, ends) + RIDGE)
        z += value[leaf]
        features.append(f)
        thresholds.append(t)
        leaves.append(value)
    return Boosted(np.array(features), np.array(thresholds), np.array(leaves), start)
