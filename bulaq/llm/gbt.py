"""Gradient-boosted trees on histograms, flattened into numpy node arrays, with monotonic constraints; isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    """Node arrays of all trees: ``feature`` is -1 at a leaf; a value not above ``threshold`` goes left."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaf values of each row; all rows step down one tree at a time."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                low = x[rows, np.where(inner, f, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(
    x: np.ndarray, y: np.ndarray, monotone: list[int] | None = None, rounds: int = 60, depth: int = 4, rate: float = 0.15, ridge: float = 1.0, least: int = 8
) -> Trees:
    """Logistic boosting; ``monotone`` has +1, -1 or 0 for each feature. Ties between splits go to the lower feature and threshold."""
    n, m = x.shape
    sign = np.zeros(m, int) if monotone is None else np.array(monotone)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) if n else np.zeros(1) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], 1) if m else np.zeros((n, 0), int)
    rate_of = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(rate_of / (1 - rate_of)))
    score = np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        for a, b in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, v)):
            a.append(b)
        return len(feature) - 1

    def best(g: np.ndarray, h: np.ndarray, rows: np.ndarray, lo: float, hi: float):
        found = (1e-6, -1, 0, 0.0, 0.0)
        gs, hs = g[rows].sum(), h[rows].sum()
        here = gs * gs / (hs + ridge)
        for j in range(m):
            k = len(cuts[j]) + 1
            b = binned[rows, j]
            gl = np.cumsum(np.bincount(b, g[rows], k))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], k))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=k))[:-1]
            gr, hr = gs - gl, hs - hl
            vl, vr = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-gr / (hr + ridge), lo, hi)
            gain = np.where((nl >= least) & (len(rows) - nl >= least), gl * gl / (hl + ridge) + gr * gr / (hr + ridge) - here, -1.0)
            if sign[j]:
                gain[(vr - vl) * sign[j] < 0] = -1
            if len(gain) and gain.max() > found[0]:
                c = int(gain.argmax())
                found = (float(gain[c]), j, c, float(vl[c]), float(vr[c]))
        return found

    def grow(g, h, rows, level, lo, hi) -> int:
        v = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), lo, hi))
        gain, j, c, vl, vr = best(g, h, rows, lo, hi) if level < depth and len(rows) >= 2 * least else (0, -1, 0, 0, 0)
        if j < 0:
            score[rows] += rate * v
            return leaf(rate * v)
        me = leaf(0.0)
        feature[me], threshold[me] = j, float(cuts[j][c])
        below = binned[rows, j] <= c
        mid = (vl + vr) / 2
        bounds = {1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid)), 0: ((lo, hi), (lo, hi))}[int(sign[j])]
        left[me] = grow(g, h, rows[below], level + 1, *bounds[0])
        right[me] = grow(g, h, rows[~below], level + 1, *bounds[1])
        return me

    for _ in range(rounds if n else 0):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(p - y, p * (1 - p), np.arange(n), 0, -8.0, 8.0))
    ints = lambda a: np.array(a, np.int64)
    return Trees(ints(roots), ints(feature), np.array(threshold, float), ints(left), ints(right), np.array(value, float), base, depth)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit by pooling adjacent violators; use with np.interp."""
    if len(score) == 0:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    at, inverse = np.unique(score, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, y) / weight
    blocks: list[list[float]] = []
    for i in range(len(at)):
        blocks.append([mean[i], weight[i], at[i], at[i]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, _, e = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [(a[0] * a[1] + v * w) / (a[1] + w), a[1] + w, a[2], e]
    xs = [e for b in blocks for e in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    ys = [b[0] for b in blocks for _ in ((0, 1) if b[3] > b[2] else (0,))]
    return np.array(xs), np.array(ys)
