"""Gradient-boosted regression trees on a bounded sample, in numpy, and their translation to Spark columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A condition (feature index, threshold, goes left): ``x <= threshold`` if left, else ``x > threshold``.
Condition = tuple[int, float, bool]


@dataclass
class Node:
    value: float
    feature: int = -1
    threshold: float = 0.0
    left: "Node | None" = None
    right: "Node | None" = None


def quantile_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Candidate thresholds of each feature: midpoints between distinct values, at most ``bins``."""
    edges = []
    for column in x.T:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1))) if len(column) else np.zeros(0)
        edges.append((values[1:] + values[:-1]) / 2)
    return edges


def _grow(codes: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, least: int, ridge: float) -> Node:
    g, h = grad[rows].sum(), hess[rows].sum()
    node = Node(float(g / (h + ridge)))
    if depth == 0 or len(rows) < 2 * least:
        return node
    best, base = (1e-6, -1, -1), g * g / (h + ridge)
    for f, cuts in enumerate(edges):
        if not len(cuts):
            continue
        at = codes[rows, f]
        gl = np.cumsum(np.bincount(at, grad[rows], len(cuts) + 1))[:-1]
        hl = np.cumsum(np.bincount(at, hess[rows], len(cuts) + 1))[:-1]
        nl = np.cumsum(np.bincount(at, minlength=len(cuts) + 1))[:-1]
        gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - base
        gain[(nl < least) | (len(rows) - nl < least)] = -1
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), f, k)
    if best[1] < 0:
        return node
    node.feature, node.threshold = best[1], float(edges[best[1]][best[2]])
    goes = codes[rows, node.feature] <= best[2]
    node.left = _grow(codes, edges, grad, hess, rows[goes], depth - 1, least, ridge)
    node.right = _grow(codes, edges, grad, hess, rows[~goes], depth - 1, least, ridge)
    return node


def predict(node: Node, x: np.ndarray) -> np.ndarray:
    if node.left is None or node.right is None:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.threshold, predict(node.left, x), predict(node.right, x))


def boost(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float = 0.3, least: int = 5, ridge: float = 1.0, bins: int = 64) -> tuple[float, list[Node]]:
    """Start value and trees of a logistic model; ``y`` is 0 or 1. One class or no rows gives no trees."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return start, []
    edges = quantile_edges(x, bins)
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    # x <= edge k exactly when fewer than k + 1 edges lie below x.
    margin, found = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(codes, edges, y - p, np.maximum(p * (1 - p), 1e-6), np.arange(len(y)), depth, least, ridge)
        if tree.left is None:
            break
        margin += rate * predict(tree, x)
        found.append(tree)
    return start, found


def paths(node: Node, prefix: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    """The path to every node below the root, as a conjunction of conditions."""
    if node.left is None or node.right is None:
        return []
    out = []
    for child, goes in ((node.left, True), (node.right, False)):
        path = (*prefix, (node.feature, node.threshold, goes))
        out += [path, *paths(child, path)]
    return out


def holds(path: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, (x[:, f] <= t if goes else x[:, f] > t for f, t, goes in path))


def path_column(path: tuple[Condition, ...], columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, (columns[f] <= F.lit(t) if goes else columns[f] > F.lit(t) for f, t, goes in path))


def tree_column(node: Node, columns: list[Column]) -> Column:
    """The tree as nested conditions; it stays inside whole-stage code generation."""
    if node.left is None or node.right is None:
        return F.lit(node.value)
    return F.when(columns[node.feature] <= F.lit(node.threshold), tree_column(node.left, columns)).otherwise(tree_column(node.right, columns))
