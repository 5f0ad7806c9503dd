"""Small gradient-boosted trees for two classes, fitted in numpy on a bounded table."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    """A leaf, or a split: values of the feature up to ``cut`` go left."""

    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(x), self.value)
        low = x[:, self.feature] <= self.cut
        return np.where(low, self.left.predict(x), self.right.predict(x))

    def column(self, features: list[Column]) -> Column:
        if self.left is None:
            return F.lit(float(self.value))
        low = features[self.feature] <= F.lit(float(self.cut))
        return F.when(low, self.left.column(features)).otherwise(self.right.column(features))


def grow(
    x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: int, cuts: int = 32
) -> Node:
    """A regression tree on gradients; splits are searched among ``cuts`` quantiles."""
    leaf = Node(float(-grad.sum() / (hess.sum() + 1.0)))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    best, spot = 1e-6, None
    base = grad.sum() ** 2 / (hess.sum() + 1.0)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, g, h = x[order, j], np.cumsum(grad[order]), np.cumsum(hess[order])
        at = np.unique(np.linspace(least, len(x) - least, cuts).astype(int)) - 1
        at = at[(at >= 0) & (at < len(x) - 1)]
        # A cut stands between two different values: go on to the last row of a value.
        at = np.unique(np.searchsorted(v, v[at], side="right") - 1)
        at = at[(at + 1 >= least) & (at + 1 <= len(x) - least)]
        if len(at):
            gain = g[at] ** 2 / (h[at] + 1.0) + (g[-1] - g[at]) ** 2 / (h[-1] - h[at] + 1.0) - base
            k = int(gain.argmax())
            if gain[k] > best:
                best, spot = gain[k], (j, float((v[at[k]] + v[at[k] + 1]) / 2))
    if spot is None:
        return leaf
    low = x[:, spot[0]] <= spot[1]
    if low.all() or not low.any():  # the middle was rounded to the upper value
        return leaf
    return Node(
        leaf.value, spot[0], spot[1],
        grow(x[low], grad[low], hess[low], depth - 1, least, cuts),
        grow(x[~low], grad[~low], hess[~low], depth - 1, least, cuts),
    )


@dataclass
class Boosted:
    """Logistic sum of trees."""

    start: float
    rate: float
    trees: list[Node] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def column(self, features: list[Column]) -> Column:
        total = F.lit(float(self.start))
        for tree in self.trees:
            total = total + F.lit(float(self.rate)) * tree.column(features)
        return total


def boost(
    x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, least: int = 5
) -> Boosted:
    """Fit; with one class or no rows at all the model is a constant near that class."""
    model = Boosted(float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), rate)
    if len(y) == 0 or y.min() == y.max():
        return model
    logit = np.full(len(y), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-logit))
        tree = grow(x, p - y, p * (1 - p), depth, least)
        model.trees.append(tree)
        logit += rate * tree.predict(x)
    return model
