"""Gradient-boosted trees on a bounded sample: histogram splits, logistic loss, optional monotonic constraints.

A model is a set of flat node arrays: feature (-1 for a leaf), threshold (left if value <= threshold),
left, right, value. Fitting is small work on the driver; scoring is vectorised and runs in tasks.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Forest:
    base: float
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    left: list[np.ndarray] = field(default_factory=list)
    right: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def flat(self) -> dict[str, np.ndarray]:
        """All trees in one set of arrays, with the root of each tree."""
        size = [len(f) for f in self.feature]
        off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32) if size else np.zeros(1, np.int32)
        cat = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.zeros(0, kind)
        return {"root": off[:-1], "feature": cat(self.feature, np.int32), "threshold": cat(self.threshold, np.float64),
                "left": cat([x + o for x, o in zip(self.left, off)], np.int32),
                "right": cat([x + o for x, o in zip(self.right, off)], np.int32),
                "value": cat(self.value, np.float64), "base": np.array([self.base])}


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def margin(flat: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Sum of leaf values for each row. All rows go down one tree together, a level per step."""
    out = np.full(len(x), flat["base"][0])
    rows = np.arange(len(x))
    for root in flat["root"]:
        node = np.full(len(x), root, dtype=np.int32)
        while True:
            f = flat["feature"][node]
            inner = f >= 0
            if not inner.any():
                break
            go = x[rows, np.maximum(f, 0)] <= flat["threshold"][node]
            node = np.where(inner, np.where(go, flat["left"][node], flat["right"][node]), node)
        out += flat["value"][node]
    return out


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48,
        min_leaf: int = 10, l2: float = 1.0, monotone: dict[int, int] | None = None, subsample: float = 1.0, seed: int = 7) -> Forest:
    """``monotone[j]`` = 1: the score may not fall as feature j rises; -1: it may not rise.

    No rows or one class only: a constant model, the (smoothed) share of label 1.
    """
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Forest(float(np.log(prior / (1 - prior))))
    if len(y) < 2 or y.min() == y.max():
        return model
    sign = np.zeros(x.shape[1], dtype=int)
    for j, s in (monotone or {}).items():
        sign[j] = s
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    coded = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    z = np.full(len(y), model.base)
    rng = np.random.default_rng(seed)
    for _ in range(n_trees):
        p = sigmoid(z)
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        use = np.arange(len(y)) if subsample >= 1 else np.flatnonzero(rng.random(len(y)) < subsample)
        feature, threshold, left, right, value = [], [], [], [], []

        def grow(idx: np.ndarray, level: int, lo: float, hi: float) -> int:
            me = len(feature)
            gs, hs = g[idx].sum(), h[idx].sum()
            v = float(np.clip(gs / (hs + l2), lo, hi))
            feature.append(-1); threshold.append(0.0); left.append(me); right.append(me); value.append(rate * v)
            if level == depth or len(idx) < 2 * min_leaf:
                return me
            best = (1e-6, -1, 0, 0.0, 0.0)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b = coded[idx, j]
                n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                gl = np.cumsum(np.bincount(b, g[idx], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[idx], len(c) + 1))[:-1]
                gr, hr = gs - gl, hs - hl
                vl, vr = np.clip(gl / (hl + l2), lo, hi), np.clip(gr / (hr + l2), lo, hi)
                gain = gl * gl / (hl + l2) + gr * gr / (hr + l2) - gs * gs / (hs + l2)
                ok = (n >= min_leaf) & (len(idx) - n >= min_leaf)
                if sign[j]:
                    ok &= sign[j] * (vr - vl) >= 0
                gain = np.where(ok, gain, -1.0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
            _, j, k, vl, vr = best
            if j < 0:
                return me
            feature[me], threshold[me] = j, float(cuts[j][k])
            go = coded[idx, j] <= k
            # Bounds of the children keep every later split on the right side of this one.
            mid = (vl + vr) / 2
            bl, br = ((lo, mid), (mid, hi)) if sign[j] > 0 else ((mid, hi), (lo, mid)) if sign[j] < 0 else ((lo, hi), (lo, hi))
            left[me] = grow(idx[go], level + 1, *bl)
            right[me] = grow(idx[~go], level + 1, *br)
            return me
        grow(use, 0, -np.inf, np.inf)
        tree = Forest(0.0, [np.array(feature, np.int32)], [np.array(threshold)], [np.array(left, np.int32)], [np.array(right, np.int32)], [np.array(value)])
        z += margin(tree.flat(), x)
        for name in ("feature", "threshold", "left", "right", "value"):
            getattr(model, name).append(getattr(tree, name)[0])
    return model
