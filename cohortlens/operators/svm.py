"""Kernel SVM, re-aimed for Spark.

The exact RBF C-SVC is a single-machine solver.  Here the RBF kernel
``exp(-gamma |x - x'|^2)`` is approximated by seeded random Fourier features
(Rahimi & Recht 2007): ``z_d(x) = sqrt(2/D) cos(w_d.x + b_d)``, ``w_d ~
N(0, 2 gamma I)``, ``b_d ~ U(0, 2 pi)``.  The map is computed inside the
executor tasks of the batched Newton solver (``glm.fit_many(family=
"sqhinge")``: L2-regularised squared hinge, per-row class weights), so the
D-wide feature table is never materialised.  Probabilities come from Platt
scaling: a one-feature logistic fit on decision values of rows that the
deciding model has not seen (``cross_fitted_platt``), as in-sample decisions
are too sure of themselves.  This approximates, and does not equal, the
kernel solution; results are deterministic for a given seed.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.glm import Fit, Input, Judged, Spec, fit_many, model_sums, score_many


def fourier_basis(n_features: int, gamma: float, dim: int = 64, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Seeded (omega, offset) of the RBF random Fourier map."""
    rng = np.random.default_rng(seed)
    omega = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(n_features, dim))
    offset = rng.uniform(0.0, 2.0 * math.pi, size=dim)
    return omega, offset


def svm_spec(cols: Sequence[str], gamma: float, cost: float, dim: int = 64, seed: int = 1, **kw) -> Spec:
    """One RBF-approximating SVM candidate over ``cols``."""
    return Spec(tuple(cols), cost=cost, fourier=fourier_basis(len(cols), gamma, dim, seed), **kw)


def fit_svms(df: DataFrame | Input, specs: Mapping[str, Spec], label: str, tol: float = 1e-8,
             max_iter: int = 30) -> dict[str, Fit]:
    """Fit many SVM candidates (feature sets x costs x gammas x folds x
    weights) in one batched Newton run."""
    return fit_many(df, specs, label, "sqhinge", tol=tol, max_iter=max_iter)


def with_decisions(df: DataFrame, specs: Mapping[str, Spec], fits: Mapping[str, Fit],
                   names: Mapping[str, str] | None = None) -> DataFrame:
    """Append the decision value f(x) of each model (positive -> class 1)."""
    names = names or {k: k for k in specs}
    return score_many(df, {names[k]: (specs[k], fits[k]) for k in specs})


@dataclass
class Platt:
    """P(label = 1 | decision) = 1 / (1 + exp(-(intercept + slope * decision)))."""
    intercept: float
    slope: float
    converged: bool

    def probability(self, decision: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.intercept) + F.lit(self.slope) * decision)))


def platt_scales(df: DataFrame, models: Sequence[Judged], label: str, tol: float = 1e-8, max_iter: int = 50) -> list[Platt]:
    """A logistic fit of the label on the decision values of each model, over the
    rows that the model judges; six sums a model and Newton step, in the tasks."""
    at, last = np.zeros((len(models), 2)), np.full(len(models), np.inf)
    open_, converged = np.ones(len(models), bool), np.zeros(len(models), bool)
    for _ in range(max_iter):
        todo, now = np.flatnonzero(open_).tolist(), at.copy()

        def step(i: int, y: np.ndarray, score: np.ndarray, ab=now[todo]) -> list[float]:
            eta = ab[i, 0] + ab[i, 1] * score
            p = 1.0 / (1.0 + np.exp(-eta))
            w, g = p * (1 - p), y - p
            loss = np.logaddexp(0.0, eta) - y * eta
            return [w.sum(), (w * score).sum(), (w * score * score).sum(), g.sum(), (g * score).sum(), loss.sum()]

        for i, (a, b, c, g0, g1, loss) in zip(todo, model_sums(df, [models[i] for i in todo], label, 6, step)):
            if abs(last[i] - loss) <= tol * (abs(loss) + 0.1):
                open_[i], converged[i] = False, True
                continue
            det = a * c - b * b
            if not det > 1e-12 * a * c:  # one decision value, or separated classes: no further step
                open_[i] = False
                continue
            last[i] = loss
            at[i] += [(c * g0 - b * g1) / det, (a * g1 - b * g0) / det]
        if not open_.any():
            break
    return [Platt(float(a), float(b), bool(ok)) for (a, b), ok in zip(at, converged)]


def cross_fitted_platt(df: DataFrame, specs: Mapping[str, Spec], label: str, fold_col: Mapping[str, str],
                       k: int = 10, start: Mapping[str, Fit] | None = None) -> dict[str, Platt]:
    """Platt scales of many SVMs from out-of-fold decisions: each training row is
    decided by the model fitted without the row's fold (``fold_col``: name ->
    column of folds 0..k-1), all k models of all SVMs in one batched run."""
    parts = {f"{n}|{j}": replace(s, fold_col=fold_col[n], exclude_fold=j, beta0=None if start is None else start[n].beta)
             for n, s in specs.items() for j in range(k)}
    with Input(df, parts, label) as data:
        fits = fit_svms(data, parts, label)
        models = [Judged(s, rows=s.include, folds={j: fits[f"{n}|{j}"] for j in range(k)}, fold_col=fold_col[n]) for n, s in specs.items()]
        return dict(zip(specs, platt_scales(data.df, models, label)))


def cv_errors(df: DataFrame, models: Sequence[Judged], label: str) -> list[float]:
    """Out-of-fold misclassification of each model (``folds``): share of its rows
    on the wrong side of 0, counted in the tasks; NaN without rows."""
    counts = model_sums(df, models, label, 2, lambda i, y, score: [((score > 0) != (y == 1)).sum(), len(y)])
    return [float(wrong / n) if n else math.nan for wrong, n in counts]
