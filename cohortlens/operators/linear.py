"""Linear models from one pass (G5-G7, G9, G12 core).

``gram()`` is the only distributed step: it reduces the rows of ``[1, x_1..x_p,
y]`` to one triangular factor per fold (``factor.factors``).  Every subset
model, every stepwise step and every CV fold is then a small least-squares
problem on the driver, so linear stepwise selection scans the data once per
training set instead of once per candidate; and as the cross products are
never formed, a column whose mean is a million times its deviation keeps its
digits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from cohortlens.operators.factor import factors, least_squares, stacked
from cohortlens.operators.glm import INTERCEPT, Fit


@dataclass
class Gram:
    """Factors of [1, features..., y]: ``total' total`` are the cross products of all rows, and so per fold."""
    features: list[str]
    label: str
    total: np.ndarray
    folds: dict[int, np.ndarray]

    def _idx(self, cols: Sequence[str]) -> list[int]:
        pos = {c: i + 1 for i, c in enumerate(self.features)}
        return [0, *[pos[c] for c in cols]]

    def solve(self, cols: Sequence[str], M: np.ndarray | None = None) -> Fit:
        """OLS of ``label ~ cols`` from a factor (all rows by default)."""
        M = self.total if M is None else M
        A, y = M[:, self._idx(cols)], M[:, len(self.features) + 1]
        n = float(round(M[:, 0] @ M[:, 0]))
        beta, kept, root, rss = least_squares(A, y)
        f = Fit("gaussian", [INTERCEPT, *cols], beta, root, kept, rss, n, 1, True, rss)
        tss = least_squares(M[:, :1], y)[3]
        k = len(kept)
        f.extra["r2"] = 1 - rss / tss if tss > 0 else float("nan")
        f.extra["adj_r2"] = 1 - (rss / (n - k)) / (tss / (n - 1)) if tss > 0 and n > max(k, 1) else float("nan")
        return f

    def sse(self, fit: Fit, M: np.ndarray) -> tuple[float, float]:
        """Sum of squared errors and row count of ``fit`` on the rows summarised by ``M``."""
        rest = M[:, len(self.features) + 1] - M[:, self._idx(fit.names[1:])] @ np.nan_to_num(fit.beta)
        return float(rest @ rest), float(round(M[:, 0] @ M[:, 0]))

    def cv_mse(self, cols: Sequence[str]) -> float:
        """K-fold CV MSE, averaged over folds (the others' factors stacked give the training rows')."""
        errs = []
        for k, Mk in sorted(self.folds.items()):
            rest = [M for j, M in self.folds.items() if j != k]
            if not rest:
                continue
            f = self.solve(cols, stacked(rest))
            sse, nk = self.sse(f, Mk)
            errs.append(sse / nk)
        return float(np.mean(errs)) if errs else float("nan")


def gram(df: DataFrame, features: Sequence[str], label: str, fold_col: str | None = None) -> Gram:
    """One distributed pass: the factor of [1, x, y], per fold where a fold column is given."""
    return gram_many(df, features, label, {"all": (None, fold_col)})["all"]


def gram_many(df: DataFrame, features: Sequence[str], label: str,
              sets: dict[str, tuple[str | None, str | None]]) -> dict[str, Gram]:
    """One pass for several training sets: ``sets`` maps a name to (0/1
    include column or None, fold column or None).  A row counts in every set
    that includes it."""
    feats = list(features)
    per = factors(df, [*feats, label], sets)
    out = {}
    for name, folds in per.items():
        total = stacked(list(folds.values())) if folds else np.zeros((1, len(feats) + 2))
        out[name] = Gram(feats, label, total, folds if sets[name][1] else {})
    return out


def stepwise_gram(g: Gram, terms: dict[str, list[str]], start: Sequence[str]) -> tuple[list[str], Fit, list[tuple]]:
    """G8 for linear models: bidirectional stepAIC on the Gram matrix.

    ``terms`` maps a formula term (a factor or a numeric) to its columns; a
    factor enters and leaves as a block.  AIC = n log(RSS/n) + 2k.  Returns
    (selected terms, fit, path); ``fit.extra["finished"]`` says that no step
    improved any more.  No data pass: every candidate is a solve.
    """
    finished = False
    current = list(start)
    cols = lambda ts: [c for t in ts for c in terms[t]]
    fit = g.solve(cols(current))
    aic = fit.aic()
    path = [("start", None, aic)]
    for _ in range(4 * len(start) + 4):
        cands = [("drop", t, [x for x in current if x != t]) for t in current]
        cands += [("add", t, [x for x in start if x in current or x == t]) for t in start if t not in current]
        best = None
        for action, t, ts in cands:
            f = g.solve(cols(ts))
            a = f.aic()
            if best is None or a < best[0]:
                best = (a, action, t, ts, f)
        if best is None or best[0] >= aic:
            finished = True
            break
        aic, action, t, current, fit = best[0], best[1], best[2], best[3], best[4]
        path.append((action, t, aic))
    fit.extra["finished"] = finished
    return current, fit, path
