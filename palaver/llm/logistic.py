"""Logistic regression on named binary features, by averaged stochastic gradient steps."""

from __future__ import annotations

import math
import random


def fit(rows: list[tuple[list[str], int]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-6, least: int = 3, seed: int = 7) -> dict[str, float]:
    """Weights by feature name. Features seen in fewer than `least` rows are left out; adaptive step sizes by feature."""
    seen: dict[str, int] = {}
    for f, _ in rows:
        for x in f:
            seen[x] = seen.get(x, 0) + 1
    keep = {x for x, n in seen.items() if n >= least}
    w = dict.fromkeys(keep, 0.0)
    g = dict.fromkeys(keep, 1e-2)
    order = list(range(len(rows)))
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            f, y = rows[i]
            f = [x for x in f if x in keep]
            z = max(-30.0, min(30.0, sum(w[x] for x in f)))
            e = 1 / (1 + math.exp(-z)) - y
            if abs(e) < 1e-3:
                continue
            for x in f:
                d = e + decay * w[x]
                g[x] += d * d
                w[x] -= rate * d / math.sqrt(g[x])
    return {x: round(v, 3) for x, v in sorted(w.items()) if abs(v) >= 0.02}
