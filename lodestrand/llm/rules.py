"""A sparse rule ensemble: tree paths as rules, lasso logistic weights, Spark columns.

Small boosted trees are grown on statistics; every path from a root to a node is a rule, a
conjunction of comparisons. A logistic model with an L1 penalty keeps few of them. What is left is
a sum of weighted conditions, which compiles to one column expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: One comparison: (feature, True for "<=" or False for ">", threshold).
Test = tuple[int, bool, float]


@dataclass(frozen=True)
class Ensemble:
    names: tuple[str, ...]
    rules: tuple[tuple[Test, ...], ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self) -> Column:
        """The probability of label 1 as an expression over columns with the names of the statistics."""
        def one(rule: tuple[Test, ...]) -> Column:
            return reduce(lambda a, b: a & b, [F.col(self.names[f]) <= t if low else F.col(self.names[f]) > t for f, low, t in rule])

        total = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights):
            total = total + F.when(one(rule), F.lit(float(w))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights):
            z += w * holds(rule, x)
        return 1 / (1 + np.exp(-z))


def holds(rule: tuple[Test, ...], x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [x[:, f] <= t if low else x[:, f] > t for f, low, t in rule])


def _grow(codes: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: int):
    """A regression tree by Newton steps over binned features: its node paths, and the step of each row."""
    n, k = codes.shape
    step, paths = np.zeros(n), []

    def split(rows: np.ndarray, path: tuple[Test, ...]) -> None:
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if len(path) < depth and len(rows) >= 2 * least:
            for f in range(k):
                m = len(edges[f])
                if not m:
                    continue
                c = codes[rows, f]
                gl = np.cumsum(np.bincount(c, g[rows], m + 1))[:-1]
                hl = np.cumsum(np.bincount(c, h[rows], m + 1))[:-1]
                nl = np.cumsum(np.bincount(c, minlength=m + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(nl < least) | (len(rows) - nl < least)] = 0
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], f, at)
        if best[1] is None:
            step[rows] = gs / (hs + 1)
            return
        _, f, at = best
        low = codes[rows, f] <= at
        for side, part in ((True, rows[low]), (False, rows[~low])):
            own = (*path, (f, side, float(edges[f][at])))
            paths.append(own)
            split(part, own)

    split(np.arange(n), ())
    return paths, step


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty, by accelerated proximal gradient steps; the intercept is free."""
    n, k = r.shape
    mean = r.mean(0)
    x = r - mean
    v = np.ones(k, np.float32) / max(1, np.sqrt(k))
    for _ in range(12):  # the largest eigenvalue bounds the step
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-12
    size = 1 / (0.25 * float(np.linalg.norm(x @ v) ** 2) / n + 1e-9)
    w = z = np.zeros(k, np.float32)
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    b = c = float(np.log(p / (1 - p)))
    t = 1.0
    for _ in range(rounds):
        d = (1 / (1 + np.exp(-(x @ z + c)))).astype(np.float32) - y
        new = z - size * (x.T @ d) / n
        new = (np.sign(new) * np.maximum(np.abs(new) - size * penalty, 0)).astype(np.float32)
        fresh = c - 4 * float(d.mean()) * 0.5
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, c = new + (t - 1) / s * (new - w), fresh + (t - 1) / s * (fresh - b)
        w, b, t = new, fresh, s
    return w, b - float(mean @ w)


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(names: list[str], x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, most: int = 400, seed: int = 3) -> Ensemble:
    """Rules and weights for label 1. With no rows or one label only, the score is a constant."""
    if len(y) < 40 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(tuple(names), (), (), float(np.log(p / (1 - p))))
    y = y.astype(np.float32)
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 40))) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[tuple[Test, ...], None] = {}
    least = max(5, len(y) // 400)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        take = rng.random(len(y)) < 0.6
        paths, _ = _grow(codes[take], edges, (y - p)[take], (p * (1 - p))[take], depth, least)
        rules.update(dict.fromkeys(paths))
        _, step = _grow(codes, edges, y - p, p * (1 - p), depth, least)
        z += 0.2 * step
    made, columns, seen = [], [], set()
    for rule in rules:
        c = holds(rule, x)
        key = c.tobytes()
        if key not in seen and 0 < c.sum() < len(c):
            seen.add(key)
            made.append(rule)
            columns.append(c)
    r = np.stack(columns, 1).astype(np.float32)
    spread = r.std(0)
    order = np.argsort(-np.abs((r - r.mean(0)).T @ (y - y.mean())) / (spread * len(y) + 1e-9), kind="stable")[:most]
    r, made = r[:, order], [made[k] for k in order]
    test = rng.random(len(y)) < 0.25
    penalties = [0.01, 0.004, 0.0015, 0.0006]
    losses = []
    for q in penalties:
        w, b = _lasso(r[~test], y[~test], q)
        losses.append(_loss(r[test] @ w + b, y[test]))
    w, b = _lasso(r, y, penalties[int(np.argmin(losses))])
    keep = np.flatnonzero(np.abs(w) > 1e-4)
    return Ensemble(tuple(names), tuple(made[k] for k in keep), tuple(float(w[k]) for k in keep), float(b))
