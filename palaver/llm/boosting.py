"""Gradient-boosted trees for binary labels on small integer features, in numpy; trees are plain lists, so that a model is JSON."""

from __future__ import annotations

import math

import numpy as np


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, l2: float, least: float) -> list:
    """[feature, threshold, left, right] (left: value <= threshold) or [value]."""
    gs, hs = g[rows].sum(), h[rows].sum()
    leaf = [round(float(-gs / (hs + l2)), 4)]
    if depth == 0 or hs < 2 * least:
        return leaf
    best, at = 1e-6, None
    base = gs * gs / (hs + l2)
    for j in range(x.shape[1]):
        v = x[rows, j]
        top = int(v.max()) if len(v) else 0
        if top == int(v.min()):
            continue
        gb, hb = np.bincount(v, g[rows], top + 1).cumsum()[:-1], np.bincount(v, h[rows], top + 1).cumsum()[:-1]
        gain = gb**2 / (hb + l2) + (gs - gb) ** 2 / (hs - hb + l2) - base
        gain[(hb < least) | (hs - hb < least)] = 0
        k = int(gain.argmax())
        if gain[k] > best:
            best, at = gain[k], (j, k)
    if at is None:
        return leaf
    j, k = at
    left = x[rows, j] <= k
    return [j, k, _tree(x, g, h, rows[left], depth - 1, l2, least), _tree(x, g, h, rows[~left], depth - 1, l2, least)]


def value(tree: list, x: tuple) -> float:
    while len(tree) == 4:
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def _values(tree: list, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    left = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[left], out[~left] = _values(tree[2], x[left]), _values(tree[3], x[~left])
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, l2: float = 1.0, least: float = 2.0) -> dict:
    """Boosted trees with logistic loss; x holds small non-negative integers."""
    p = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
    bias = math.log(p / (1 - p))
    z = np.full(len(y), bias)
    trees = []
    rows = np.arange(len(y))
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-z))
        t = _tree(x, q - y, q * (1 - q), rows, depth, l2, least)
        if len(t) == 1:
            break
        z += rate * _values(t, x)
        trees.append(t)
    return {"bias": bias, "rate": rate, "trees": trees}


def probability(model: dict, x: tuple) -> float:
    z = model["bias"] + model["rate"] * sum(value(t, x) for t in model["trees"])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.full(len(x), model["bias"])
    for t in model["trees"]:
        z += model["rate"] * _values(t, x)
    return 1 / (1 + np.exp(-z))
