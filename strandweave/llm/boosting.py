"""Small gradient-boosted trees, trained on the driver and scored as one SQL expression."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: (feature, threshold, left, right); a leaf is a number. Left is feature <= threshold.
Tree = tuple[int, float, "Tree", "Tree"] | float


def _leaf(grad: np.ndarray, hess: np.ndarray) -> float:
    return round(float(grad.sum() / (hess.sum() + 1.0)), 6)


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int) -> Tree:
    best, gain = None, 1e-6
    score = lambda g, h: g.sum() ** 2 / (h.sum() + 1.0)
    for j in range(x.shape[1] if depth else 0):
        values = np.unique(x[:, j])
        for cut in (values[:-1] + values[1:]) / 2:
            left = x[:, j] <= cut
            g = score(grad[left], hess[left]) + score(grad[~left], hess[~left]) - score(grad, hess)
            if g > gain:
                best, gain = (j, float(cut), left), g
    if best is None:
        return _leaf(grad, hess)
    j, cut, left = best
    return j, cut, _grow(x[left], grad[left], hess[left], depth - 1), _grow(x[~left], grad[~left], hess[~left], depth - 1)


def predict(tree: Tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    j, cut, left, right = tree
    return np.where(x[:, j] <= cut, predict(left, x), predict(right, x))


def predict_one(tree: Tree, row: Sequence[float]) -> float:
    while not isinstance(tree, float):
        j, cut, left, right = tree
        tree = left if row[j] <= cut else right
    return tree


def train(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.5) -> list[Tree]:
    """Trees whose sum is the log-odds of y, with the logistic loss's gradients."""
    trees, total = [], np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        tree = _grow(x, rate * (y - p), p * (1 - p), depth)
        trees.append(tree)
        total += predict(tree, x)
    return trees


def calibrate(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest threshold on held-out scores at which the given precision is reached, halfway to the next lower score."""
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ok = np.flatnonzero(right >= precision)
    if not len(ok):
        return float("inf")
    least = scores[order][ok[-1]]
    lower = scores[scores < least]
    return float((least + lower.max()) / 2) if len(lower) else float(least)


def as_sql(trees: list[Tree], feature: Callable[[int], str]) -> str:
    """The trees' sum as an SQL expression of the features' expressions."""

    def branch(tree: Tree) -> str:
        if isinstance(tree, float):
            return f"{tree!r}D"
        j, cut, left, right = tree
        return f"CASE WHEN {feature(j)} <= {cut!r}D THEN {branch(left)} ELSE {branch(right)} END"

    return " + ".join(["0.0D", *map(branch, trees)])
