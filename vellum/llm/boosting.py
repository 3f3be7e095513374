"""Gradient-boosted regression trees for logistic loss on small bounded tables, and their SQL form."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: float, rate: float) -> Node:
    total_g, total_h = grad.sum(), hess.sum()
    leaf = Node(value=rate * total_g / (total_h + 1.0))
    if depth == 0 or total_h < 2 * least:
        return leaf
    best = (1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, g, h = x[order, f], np.cumsum(grad[order]), np.cumsum(hess[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(h[at] >= least) & (total_h - h[at] >= least)]
        if not len(at):
            continue
        gain = g[at] ** 2 / (h[at] + 1.0) + (total_g - g[at]) ** 2 / (total_h - h[at] + 1.0) - total_g**2 / (total_h + 1.0)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, float((v[at[k]] + v[at[k] + 1]) / 2))
    if best[1] < 0:
        return leaf
    side = x[:, best[1]] <= best[2]
    grown = [_grow(x[s], grad[s], hess[s], depth - 1, least, rate) for s in (side, ~side)]
    return Node(feature=best[1], cut=best[2], low=grown[0], high=grown[1])


def _apply(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    side = x[:, node.feature] <= node.cut
    out = np.empty(len(x))
    out[side], out[~side] = _apply(node.low, x[side]), _apply(node.high, x[~side])
    return out


class Trees:
    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, least: float = 1.0):
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        self.base, self.trees = float(np.log(share / (1 - share))), []
        margin = np.full(len(y), self.base)
        for _ in range(rounds if len(y) else 0):
            p = 1 / (1 + np.exp(-margin))
            tree = _grow(x, y - p, p * (1 - p), depth, least, rate)
            if tree.feature < 0:
                break
            self.trees.append(tree)
            margin += _apply(tree, x)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, features: list[Column]) -> Column:
        """The margin as one expression of nested conditions."""

        def of(node: Node) -> Column:
            if node.feature < 0:
                return F.lit(node.value)
            return F.when(features[node.feature] <= node.cut, of(node.low)).otherwise(of(node.high))

        out = F.lit(self.base)
        for tree in self.trees:
            out = out + of(tree)
        return out


def calibrate(margins: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least margin from which on at least ``precision`` of held-out candidates are positive."""
    order = np.argsort(-margins, kind="stable")
    m, hit = margins[order], np.cumsum(y[order])
    good = hit / np.arange(1, len(y) + 1) >= precision
    last = np.append(m[1:] < m[:-1], True) if len(m) else good  # equal margins are taken together
    at = np.flatnonzero(good & last)
    return float(m[at[-1]]) if len(at) else float("inf")
