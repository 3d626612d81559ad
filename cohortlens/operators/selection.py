"""Model selection (G8, G13, G14) on top of the batched fitter.

``stepwise_many`` runs any number of independent bidirectional stepAIC
searches *concurrently*: every round gathers the add/drop candidates of all
active searches into one ``fit_many`` call, so the number of Spark jobs is
(rounds x Newton iterations), not (searches x candidates x iterations).
Factors move as blocks; ties keep R's order (none, drops in formula order,
adds in scope order); AIC counts non-aliased coefficients.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from cohortlens.operators.glm import Fit, Input, Spec, fit_many


@dataclass
class Search:
    terms: dict[str, list[str]]      # term -> columns
    start: list[str]                 # starting (and upper-scope) terms, formula order
    include: str | None = None       # 0/1 column selecting the training rows
    current: list[str] = field(default_factory=list)
    fit: Fit | None = None
    path: list[tuple] = field(default_factory=list)
    done: bool = False

    def cols(self, ts: Sequence[str]) -> tuple[str, ...]:
        return tuple(c for t in ts for c in self.terms[t])


def _warm(fit: Fit | None, cols: tuple[str, ...]) -> np.ndarray | None:
    if fit is None:
        return None
    coef = fit.coefficients()
    return np.array([coef.get("(Intercept)", 0.0), *[coef.get(c, 0.0) for c in cols]])


def stepwise_many(df: DataFrame, searches: Mapping[str, Search], label: str, family: str = "binomial",
                  weight_col: str | None = None, max_rounds: int = 100, tol: float = 1e-9) -> dict[str, Search]:
    """Bidirectional stepAIC from each search's starting model.

    Every model of every round is over columns of the starting models, so one
    cached input and its factors serve all of them.  A search that still
    improves after ``max_rounds`` is returned with ``done`` false.
    """
    for s in searches.values():
        s.current = list(s.start)
    specs = {k: Spec(s.cols(s.current), include=s.include) for k, s in searches.items()}
    with Input(df, specs, label, weight_col) as data:
        return _rounds(data, specs, searches, label, family, weight_col, max_rounds, tol)


def _rounds(df: Input, specs: dict[str, Spec], searches: Mapping[str, Search], label: str, family: str,
            weight_col: str | None, max_rounds: int, tol: float) -> dict[str, Search]:
    # round 0: the starting models
    fits = fit_many(df, specs, label, family, weight_col, tol=tol)
    for k, s in searches.items():
        s.fit = fits[k]
        s.path.append(("start", None, s.fit.aic()))
    for _ in range(max_rounds):
        active = {k: s for k, s in searches.items() if not s.done}
        if not active:
            break
        specs, meta = {}, {}
        for k, s in active.items():
            cands = [("drop", t, [x for x in s.current if x != t]) for t in s.current]
            cands += [("add", t, [x for x in s.start if x in s.current or x == t])
                      for t in s.start if t not in s.current]
            if not cands:
                s.done = True
            for j, (action, t, ts) in enumerate(cands):
                key = f"{k}|{j}"
                cols = s.cols(ts)
                specs[key] = Spec(cols, beta0=_warm(s.fit, cols), include=s.include)
                meta[key] = (k, j, action, t, ts)
        if not specs:
            break
        fits = fit_many(df, specs, label, family, weight_col, tol=tol)
        best: dict[str, tuple] = {}
        for key, (k, j, action, t, ts) in meta.items():
            a = fits[key].aic()
            if k not in best or a < best[k][0]:
                best[k] = (a, j, action, t, ts, fits[key])
        for k, s in active.items():
            if k not in best:
                continue
            a, _, action, t, ts, f = best[k]
            if a >= s.fit.aic():
                s.done = True
                continue
            s.current, s.fit = list(ts), f
            s.path.append((action, t, a))
    return dict(searches)


def univariable_screen(df: DataFrame, terms: Mapping[str, list[str]], label: str,
                       family: str = "binomial") -> dict[str, Fit]:
    """One fit per term, all in one batch of jobs."""
    return fit_many(df, {t: Spec(tuple(cols)) for t, cols in terms.items()}, label, family)


def compare_models(df: DataFrame, formulas: Mapping[str, Sequence[str]], label: str,
                   family: str = "binomial") -> dict[str, Fit]:
    """Several named column lists fitted together; compare by AIC."""
    return fit_many(df, {n: Spec(tuple(cols)) for n, cols in formulas.items()}, label, family)
