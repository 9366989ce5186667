"""Gradient-boosted regression trees for a yes/no label: histogram training in numpy, trees flattened into
node arrays, vectorised scoring. Chosen features are monotonic: with rising feature the score never
falls (+1) or never rises (-1)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees one after the other in flat arrays. A leaf's children are itself, so every row takes depth steps."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def train(x: np.ndarray, y: np.ndarray, monotone: np.ndarray | None = None, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 10) -> Forest:
    """x: rows by features, finite; y: 0 or 1. Without rows, or with one class only, the forest is its base."""
    n, f = x.shape
    monotone = np.zeros(f, int) if monotone is None else np.asarray(monotone)
    p = (y.sum() + 1) / (n + 2)
    base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(f)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1) if n and f else np.zeros((n, f), int)
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots, margin = [], np.full(n, base)

    def leaf(value: float) -> int:
        at = len(nodes["value"])
        for k, v in zip(nodes, (0, 0.0, at, at, value), strict=True):
            nodes[k].append(v)
        return at

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        value = float(np.clip(-g / (h + l2), low, high))
        at = leaf(rate * value)
        best = None
        if level < depth and len(rows) >= 2 * least:
            for j in range(f):
                if not len(cuts[j]):
                    continue
                b = binned[rows, j]
                gs = np.cumsum(np.bincount(b, grad[rows], len(cuts[j]) + 1))[:-1]
                hs = np.cumsum(np.bincount(b, hess[rows], len(cuts[j]) + 1))[:-1]
                ns = np.cumsum(np.bincount(b, minlength=len(cuts[j]) + 1))[:-1]
                lv, rv = np.clip(-gs / (hs + l2), low, high), np.clip(-(g - gs) / (h - hs + l2), low, high)
                gain = gs**2 / (hs + l2) + (g - gs) ** 2 / (h - hs + l2) - g * g / (h + l2)
                gain[(ns < least) | (len(rows) - ns < least) | (monotone[j] * (rv - lv) < 0)] = -np.inf
                k = int(np.argmax(gain))
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (gain[k], j, k, lv[k], rv[k])
        if best:
            _, j, k, lv, rv = best
            mid, sign = (lv + rv) / 2, monotone[j]
            goes = binned[rows, j] <= k
            nodes["feature"][at], nodes["threshold"][at] = j, float(cuts[j][k])
            nodes["left"][at] = grow(rows[goes], level + 1, max(low, mid) if sign < 0 else low, min(high, mid) if sign > 0 else high)
            nodes["right"][at] = grow(rows[~goes], level + 1, max(low, mid) if sign > 0 else low, min(high, mid) if sign < 0 else high)
        return at

    every = np.arange(n)
    if 0 < y.sum() < n:
        for _ in range(trees):
            q = 1 / (1 + np.exp(-margin))
            grad, hess = q - y, np.maximum(q * (1 - q), 1e-6)
            roots.append(root := grow(every, 0, -10.0, 10.0))
            at = np.full(n, root)
            arrays = {k: np.asarray(v) for k, v in nodes.items()}
            for _ in range(depth):
                at = np.where(x[every, arrays["feature"][at]] <= arrays["threshold"][at], arrays["left"][at], arrays["right"][at])
            margin += arrays["value"][at]
    return Forest(np.asarray(roots, int), np.asarray(nodes["feature"], int), np.asarray(nodes["threshold"], float), np.asarray(nodes["left"], int), np.asarray(nodes["right"], int), np.asarray(nodes["value"], float), base, depth)
