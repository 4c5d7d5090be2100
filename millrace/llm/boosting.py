"""Gradient boosted trees over binned features, fitted to counts and scored as a column expression.

Rows with equal features are one entry with two counts, so fitting needs no rows, only
a table bounded by the number of bins; the counts come from all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _tree(x: np.ndarray, weight: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, ridge: float = 1.0):
    """A leaf's value, or (feature, bound, low side, high side): low is where the feature is at most the bound."""
    total_g, total_h = (weight * gradient).sum(), (weight * hessian).sum()
    best = (1e-6, None, None)
    for f in range(x.shape[1] if depth and len(x) > 1 else 0):
        g, h = np.bincount(x[:, f], weight * gradient), np.bincount(x[:, f], weight * hessian)
        low_g, low_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        high_g, high_h = total_g - low_g, total_h - low_h
        gain = low_g**2 / (low_h + ridge) + high_g**2 / (high_h + ridge) - total_g**2 / (total_h + ridge)
        if len(gain) and gain.max() > best[0]:
            best = (float(gain.max()), f, int(gain.argmax()))
    _, feature, bound = best
    if feature is None:
        return float(total_g / (total_h + ridge))
    low = x[:, feature] <= bound
    side = lambda rows: _tree(x[rows], weight[rows], gradient[rows], hessian[rows], depth - 1, ridge)
    return feature, bound, side(low), side(~low)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    feature, bound, low, high = tree
    return np.where(x[:, feature] <= bound, _value(low, x), _value(high, x))


class BoostedTrees:
    """Log-odds as a sum of small trees."""

    def __init__(self, trees: int = 20, depth: int = 3, rate: float = 0.4):
        self.size, self.depth, self.rate = trees, depth, rate
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> BoostedTrees:
        weight = (positive + negative).astype(float)
        label = positive / np.maximum(weight, 1)
        self.base = float(np.log((positive.sum() + 1) / (negative.sum() + 1)))
        score = np.full(len(x), self.base)
        for _ in range(self.size):
            p = 1 / (1 + np.exp(-score))
            tree = _tree(x, weight, label - p, p * (1 - p), self.depth)
            self.trees.append(tree)
            score += self.rate * _value(tree, x)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + self.rate * sum(_value(t, x) for t in self.trees))))

    def column(self, features: list[Column]) -> Column:
        """The same probability as an expression over feature columns."""

        def walk(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(self.rate * tree)
            feature, bound, low, high = tree
            return F.when(features[feature] <= bound, walk(low)).otherwise(walk(high))

        score = F.lit(self.base)
        for tree in self.trees:
            score = score + walk(tree)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def thresholds(
    kind: np.ndarray, score: np.ndarray, positive: np.ndarray, negative: np.ndarray, precision: float, kinds: int = 4, weight: float = 20.0
) -> dict[int, float]:
    """Per kind the smallest score from which at least ``precision`` of the rows are positive, by a smoothed estimate.

    To the counts of rows at or above a score come ``weight`` rows of which as many are
    positive as the score itself says. With no rows the score alone decides; the more
    rows there are, the more their share does.
    """
    out = {}
    for k in range(kinds):
        own = kind == k
        grid = np.unique(np.append(score[own], precision))[::-1]
        at = np.searchsorted(-grid, -score[own])
        hits = np.cumsum(np.bincount(at, positive[own], len(grid)))
        rows = np.cumsum(np.bincount(at, positive[own] + negative[own], len(grid)))
        good = (hits + weight * grid) / (rows + weight) >= precision
        out[k] = float(grid[good][-1]) if good.any() else 2.0
    return out
