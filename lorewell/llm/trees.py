"""Gradient-boosted trees in numpy: histogram splits, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees as flat arrays: feature (-1 in a leaf), threshold, left and right child, leaf value; roots of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row: all rows walk all trees in step, one gather a level."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            go_left = x[rows, np.maximum(f, 0)] <= self.threshold[node]
            node = np.where(f < 0, node, np.where(go_left, self.left[node], self.right[node]))
        return self.base + self.value[node].sum(axis=1)


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 64, least: int = 5, l2: float = 1.0) -> Forest:
    """Boosted trees for a 0/1 target with logistic loss.

    monotone maps a feature to +1 (score never falls as it grows) or -1. A split that would break
    the order is not made, and the children of one that is made inherit its midpoint as a bound,
    so that the order holds over the whole tree. Without rows, or with one class, the score is constant.
    """
    monotone = monotone or {}
    n, m = x.shape
    p = np.clip(y.mean() if n else 0.0, 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(m)]
    codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1) if n else np.zeros((0, m), int)
    nodes: list[list] = []
    roots, score = [], np.full(n, base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, lo: float, hi: float) -> int:
        me = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = lambda a, b: np.clip(-a / (b + l2), lo, hi)
        nodes.append([-1, 0.0, me, me, rate * leaf(total_g, total_h)])
        if level == depth or len(rows) < 2 * least:
            return me
        best = (1e-6, None)
        gain_of = lambda a, b, v: -(2 * a * v + (b + l2) * v * v)  # noqa: E731  loss reduction of a leaf value v
        parent = gain_of(total_g, total_h, leaf(total_g, total_h))
        for f in range(m):
            k = len(edges[f]) + 1
            if k < 2:
                continue
            c = codes[rows, f]
            gl, hl, nl = (np.cumsum(np.bincount(c, w, minlength=k))[:-1] for w in (g[rows], h[rows], None))
            vl, vr = leaf(gl, hl), leaf(total_g - gl, total_h - hl)
            gain = gain_of(gl, hl, vl) + gain_of(total_g - gl, total_h - hl, vr) - parent
            gain[(nl < least) | (len(rows) - nl < least)] = -1
            if f in monotone:
                gain[(vr - vl) * monotone[f] < 0] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], (f, at, vl[at], vr[at]))
        if best[1] is None:
            return me
        f, at, vl, vr = best[1]
        left = codes[rows, f] <= at
        bounds = ((lo, hi), (lo, hi))
        if f in monotone:
            mid = (vl + vr) / 2
            bounds = ((lo, mid), (mid, hi)) if monotone[f] > 0 else ((mid, hi), (lo, mid))
        a = grow(rows[left], g, h, level + 1, *bounds[0])
        b = grow(rows[~left], g, h, level + 1, *bounds[1])
        nodes[me][:4] = [f, float(edges[f][at]), a, b]
        return me

    for _ in range(trees if n and 0 < y.mean() < 1 else 0):
        prob = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(n), prob - y, prob * (1 - prob), 0, -8.0, 8.0))
        score = score + _flat(nodes, roots[-1:], depth, 0.0).score(x)
    return _flat(nodes, roots, depth, base)


def _flat(nodes: list[list], roots: list[int], depth: int, base: float) -> Forest:
    cols = list(zip(*nodes, strict=True)) if nodes else [[]] * 5
    return Forest(np.array(cols[0], np.int32), np.array(cols[1], float), np.array(cols[2], np.int32), np.array(cols[3], np.int32), np.array(cols[4], float), np.array(roots, np.int32), depth, base)
