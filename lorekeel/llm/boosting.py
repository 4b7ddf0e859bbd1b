"""Gradient-boosted trees for a binary target, small enough to fit on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = self.feature[node]
            node = 2 * node + 1 + (x[np.arange(len(x)), at] > self.limit[node])
        return self.value[node]


@dataclass(frozen=True)
class Booster:
    """Sum of trees, then a calibrated probability (a logistic curve over the sum)."""

    base: float
    trees: tuple[Tree, ...]
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.predict(x)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: int, ridge: float, rate: float) -> Tree:
    size = 2 ** (depth + 1) - 1
    feature, limit, value = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size)
    rows: dict[int, np.ndarray] = {0: np.arange(len(x))}
    for node in range(size):
        here = rows.pop(node, np.zeros(0, np.int64))
        g, h = grad[here].sum(), hess[here].sum()
        value[node] = rate * g / (h + ridge) if len(here) else 0.0
        if node >= 2**depth - 1:
            continue
        best = (1e-9, 0, np.inf)
        if len(here) >= 2 * least:
            for f in range(x.shape[1]):
                order = here[np.argsort(x[here, f], kind="stable")]
                v = x[order, f]
                gs, hs = np.cumsum(grad[order]), np.cumsum(hess[order])
                ok = np.flatnonzero(v[1:] > v[:-1])
                ok = ok[(ok + 1 >= least) & (len(order) - ok - 1 >= least)]
                if len(ok):
                    gain = gs[ok] ** 2 / (hs[ok] + ridge) + (g - gs[ok]) ** 2 / (h - hs[ok] + ridge) - g * g / (h + ridge)
                    i = int(np.argmax(gain))
                    if gain[i] > best[0]:
                        best = (float(gain[i]), f, float((v[ok[i]] + v[ok[i] + 1]) / 2))
        feature[node], limit[node] = best[1], best[2]
        goes = x[here, best[1]] > best[2]
        rows[2 * node + 1], rows[2 * node + 2] = here[~goes], here[goes]
    return Tree(feature, limit, value, depth)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, least: int = 12, ridge: float = 1.0) -> Booster:
    """Boosting on the logistic loss with second-order steps; the same input gives the same trees."""
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    margin, trees = np.full(len(x), base), []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        tree = _grow(x, y - q, q * (1 - q), depth, least, ridge, rate)
        trees.append(tree)
        margin += tree.predict(x)
    return Booster(base, tuple(trees))


def calibrated(model: Booster, x: np.ndarray, y: np.ndarray) -> Booster:
    """The model with its logistic curve fitted on held-out rows (Newton steps, softened targets)."""
    m = model.margin(x)
    up, n = y.sum(), len(y)
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (n - up + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((target - p) * m).sum(), (target - p).sum()])
        h = np.array([[(w * m * m).sum() + 1e-6, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return Booster(model.base, model.trees, float(a), float(b))


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest probability from which on the held-out precision is reached; above 1 if none."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(p[order][1:] < p[order][:-1], True)  # only between different probabilities
    ok = np.flatnonzero((hits >= precision) & last)
    return float(p[order][ok[-1]]) if len(ok) else 1.1
