"""Gradient-boosted trees on binned features, with monotonic constraints,
flattened into node arrays for vectorised scoring."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Forest(NamedTuple):
    """Nodes of all trees in one array each; a leaf is its own child.
    ``roots``: first node of each tree; ``depth``: steps from a root to a leaf."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row of ``x`` (rows, features)."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1.0 / (1.0 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def train(x: np.ndarray, y: np.ndarray, monotone: dict[int, int], trees: int = 80, depth: int = 4,
          rate: float = 0.15, bins: int = 64, l2: float = 5.0, least: int = 20) -> Forest:
    """Fit to labels 0/1.  ``monotone``: feature -> 1 if the score may only rise
    with it, -1 if it may only fall."""
    n, m = x.shape
    p = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)]) if n else np.zeros((m, 0), int)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        k = len(feature)
        for a, b in ((feature, 0), (threshold, np.inf), (left, k), (right, k), (value, 0.0)):
            a.append(b)
        return k

    margin = np.full(n, base)
    for _ in range(trees if n else 0):
        prob = 1 / (1 + np.exp(-margin))
        g, h = y - prob, prob * (1 - prob)
        roots.append(root := node())
        open_ = [(root, np.arange(n), -np.inf, np.inf, 0)]
        while open_:
            k, rows, low, high, level = open_.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[k] = rate * float(np.clip(gs / (hs + l2), low, high))
            best = None
            if level < depth and len(rows) >= 2 * least:
                for j in range(m):
                    if not len(cuts[j]):
                        continue
                    b = binned[j][rows]
                    gl, hl, nl = (np.cumsum(np.bincount(b, weights=w, minlength=len(cuts[j]) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                    a, c = np.clip(gl / (hl + l2), low, high), np.clip((gs - gl) / (hs - hl + l2), low, high)
                    gain = gl * a - 0.5 * (hl + l2) * a * a + (gs - gl) * c - 0.5 * (hs - hl + l2) * c * c
                    ok = (nl >= least) & (len(rows) - nl >= least)
                    if s := monotone.get(j, 0):
                        ok &= s * (c - a) >= 0
                    gain = np.where(ok, gain, -np.inf)
                    i = int(gain.argmax())
                    if best is None or gain[i] > best[0]:
                        best = (gain[i], j, i, a[i], c[i])
            whole = value[k] / rate
            if best is None or best[0] <= gs * whole - 0.5 * (hs + l2) * whole * whole + 1e-6:
                margin[rows] += value[k]
                continue
            _, j, i, a, c = best
            feature[k], threshold[k] = j, float(cuts[j][i])
            left[k], right[k] = node(), node()
            middle = (a + c) / 2
            s = monotone.get(j, 0)
            lo_l, hi_l = (low, min(high, middle)) if s > 0 else (max(low, middle), high) if s < 0 else (low, high)
            lo_r, hi_r = (max(low, middle), high) if s > 0 else (low, min(high, middle)) if s < 0 else (low, high)
            inside = binned[j][rows] <= i
            open_ += [(left[k], rows[inside], lo_l, hi_l, level + 1), (right[k], rows[~inside], lo_r, hi_r, level + 1)]
    if not roots:
        roots.append(node())
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), depth, base)
