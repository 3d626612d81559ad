"""Batched generalized-linear fitting on Spark (G1, G4, G5, G13, G18 core).

One Spark job per Newton/IRLS iteration fits *many* candidate models at once
(feature subsets x fold exclusions x searches).  Each task turns its Arrow
batches into numpy arrays and adds, per candidate, the partial sums
``X'WX, X'Wz, deviance, n`` of its rows into one vector (the symmetric part
once), sent as a few Arrow rows of ``CHUNK`` numbers; the vectors are added
chunk by chunk, in groups of ``FAN`` tasks; the driver solves the p x p systems
and sends the new coefficients with the next job.  Rows never leave the
executors, the driver's state is O(candidates * p^2), and a lost executor only
re-runs its tasks.  Errors of many models are summed in the tasks alike
(``model_sums``), or their scores returned as rows (``score_long``), each row
scored only by the models that are to judge it.

Families: ``binomial`` (logit link; R ``glm`` IRLS start and deviance),
``gaussian`` (one pass, exact), ``sqhinge`` (L2-regularised squared-hinge
SVM solved by Newton on the active set).  One pass before the iterations gives
the QR factor of each set of rows (``factor``): on it, aliased (linearly
dependent) columns are found in formula order and dropped, as R reports them
NA (AIC counts the kept columns only), and from it come the means and
deviations by which the iterations centre and scale the columns, so that the
p x p systems stay well conditioned; coefficients are given in raw units.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.factor import FAN, factors, independent, least_squares, squared_root, stacked

EPS = 2.220446049250313e-16
INTERCEPT = "(Intercept)"


@dataclass
class Spec:
    """One candidate model.

    ``cols``: feature columns (intercept implicit); ``include``: name of a 0/1
    column selecting the candidate's rows (e.g. a scenario's training set),
    so candidates over different row sets share one pass; ``exclude_fold``
    with ``fold_col``: leave one fold out; ``class_weights``: (w0, w1)
    multiplying the row weight by class; ``beta0``: warm start;
    ``cost``: C of the squared-hinge SVM.
    """
    cols: tuple[str, ...]
    exclude_fold: int | None = None
    beta0: np.ndarray | None = None
    cost: float | None = None
    include: str | None = None
    fold_col: str | None = None
    class_weights: tuple[float, float] | None = None
    fourier: tuple[np.ndarray, np.ndarray] | None = None  # (omega p x D, offset D): RFF basis

    def identity(self) -> tuple:
        """Equal for specs of the same model and start."""
        arrays = [None if a is None else np.asarray(a, dtype=float).tobytes() for a in (self.beta0, *(self.fourier or ()))]
        return self.cols, self.exclude_fold, self.cost, self.include, self.fold_col, self.class_weights, *arrays

    def basis_names(self) -> list[str]:
        if self.fourier is None:
            return list(self.cols)
        return [f"rff{d}" for d in range(self.fourier[0].shape[1])]


def _basis(X: np.ndarray, fourier) -> np.ndarray:
    """Design columns of one candidate: raw features, or random Fourier
    features sqrt(2/D) cos(X omega + b) computed on the executor."""
    if fourier is None:
        return X
    omega, offset = fourier
    return np.sqrt(2.0 / omega.shape[1]) * np.cos(X @ omega + offset)


@dataclass
class Fit:
    family: str
    names: list[str]                 # intercept first
    beta: np.ndarray                 # NaN where aliased
    root: np.ndarray                 # triangle of the information at the final coefficients (kept x kept)
    kept: list[int]
    deviance: float
    n: float
    iterations: int
    converged: bool
    rss: float | None = None
    extra: dict = field(default_factory=dict)

    @property
    def rank(self) -> int:
        return len(self.kept)

    @property
    def separated(self) -> bool:
        """The classes are told apart without error: no finite estimate exists."""
        return self.family == "binomial" and self.n > 0 and self.deviance < 1e-6 * self.n

    @property
    def aliased(self) -> list[str]:
        return [n for i, n in enumerate(self.names) if i not in self.kept]

    def aic(self) -> float:
        """binomial: deviance + 2k (0/1 response); gaussian: stepAIC's
        ``n log(RSS/n) + 2k`` (-inf for a perfect fit).  Without rows: inf."""
        if not self.n > 0:
            return math.inf
        if self.family == "gaussian" and not self.deviance > 0:
            return -math.inf
        if self.family == "gaussian":
            return self.n * math.log(self.deviance / self.n) + 2 * self.rank
        return self.deviance + 2 * self.rank

    def coefficients(self) -> dict[str, float]:
        return {self.names[i]: float(self.beta[i]) for i in self.kept}

    @property
    def xtwx(self) -> np.ndarray:
        """Information matrix X'WX of the kept columns."""
        return self.root.T @ self.root

    def cov(self) -> np.ndarray:
        """Covariance of the kept coefficients (dispersion 1 for binomial,
        RSS/(n-k) for gaussian)."""
        half = np.linalg.solve(self.root, np.eye(len(self.root)))
        inv = half @ half.T
        if self.family == "gaussian":
            inv = inv * (self.deviance / (self.n - self.rank))
        return inv

    def eta(self) -> Column:
        """Linear predictor as a literal Column expression (scored in codegen)."""
        expr = F.lit(0.0)
        for i in self.kept:
            b = F.lit(float(self.beta[i]))
            expr = expr + (b if i == 0 else b * F.col(self.names[i]))
        return expr

    def response(self) -> Column:
        if self.family == "binomial":
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.eta()))
        return self.eta()


def _eta_np(Xc, beta):
    return Xc @ np.nan_to_num(beta, nan=0.0)


def _partials(X, y, wt, beta):
    """Per-batch sums for one logistic candidate; X includes the intercept column."""
    if beta is None:
        mu = (wt * y + 0.5) / (wt + 1.0)
        eta = np.log(mu / (1 - mu))
    else:
        eta = _eta_np(X, beta)
        mu = 1.0 / (1.0 + np.exp(-eta))
    mu = np.clip(mu, EPS, 1 - EPS)
    var = mu * (1 - mu)
    w = wt * var
    z = eta + (y - mu) / var
    dev = -2.0 * float(np.sum(wt * (y * np.log(mu) + (1 - y) * np.log(1 - mu))))
    wX = w[:, None] * X
    return np.concatenate([(X.T @ wX)[np.triu_indices(X.shape[1])], z @ wX, [dev, float(np.sum(wt))]])


#: Rows that the models of a row set are evaluated on at a time, so that their numbers stay in the processor's cache.
BLOCK = 1024


def _binomial_sums(X: np.ndarray, y: np.ndarray, wt: np.ndarray, fold: np.ndarray | None,
                   models: Sequence[tuple[list[int], int | None, np.ndarray | None]]) -> list[np.ndarray | None]:
    """``_partials`` of logistic models that share rows.

    ``models``: (columns of ``X``, fold left out, coefficients); the sums come in
    their order.  Linear predictors and gradients of all models are one matrix
    product each, and so are their information matrices, over the products of all
    pairs of columns.
    """
    used = sorted({c for cols, _, _ in models for c in cols})
    place = {c: a for a, c in enumerate(used)}
    own = [np.array([place[c] for c in cols]) for cols, _, _ in models]
    X, many, width = np.ascontiguousarray(X[:, used].T), len(models), len(used)
    first, second = np.triu_indices(width)
    pair = np.zeros((width, width), int)
    pair[first, second] = pair[second, first] = np.arange(len(first))
    at = [pair[np.ix_(c, c)][np.triu_indices(len(c))] for c in own]
    B, fresh = np.zeros((many, width)), np.array([m[2] is None for m in models])
    for i, (_, _, beta) in enumerate(models):
        if beta is not None:
            B[i, own[i]] = np.nan_to_num(beta)
    left_out = np.array([np.nan if m[1] is None else m[1] for m in models])
    G, b, dev, n = np.zeros((many, len(first))), np.zeros((many, width)), np.zeros(many), np.zeros(many)
    binary = bool(((y == 0) | (y == 1)).all())
    for start in range(0, len(y), BLOCK):
        rows = slice(start, start + BLOCK)
        x, yb, wb = X[:, rows], y[rows], wt[rows]
        eta = B @ x
        if fresh.any():
            half = (wb * yb + 0.5) / (wb + 1.0)
            eta[fresh] = np.log(half / (1 - half))
            mu = 1.0 / (1.0 + np.exp(-eta))
            mu[fresh] = half
        else:
            mu = 1.0 / (1.0 + np.exp(-eta))
        np.clip(mu, EPS, 1 - EPS, out=mu)
        if fold is None:
            w = np.broadcast_to(wb, mu.shape)
        else:
            w = np.where(fold[rows][None, :] != left_out[:, None], wb, 0.0)
        if binary:
            likelihood = np.log(np.where(yb == 1, mu, 1 - mu))
        else:
            likelihood = yb * np.log(mu) + (1 - yb) * np.log(1 - mu)
        dev -= 2.0 * np.einsum("ij,ij->i", w, likelihood)
        n += w.sum(1)
        gradient = w * (yb - mu)
        w = w * (mu * (1 - mu))
        b += (w * eta + gradient) @ x.T
        G += w @ (x[first] * x[second]).T
    return [np.concatenate([G[i, at[i]], b[i, own[i]], [dev[i], n[i]]]) if n[i] > 0 else None for i in range(many)]


def _sharing_pays(columns: Sequence[Sequence[int]]) -> bool:
    """Whether the products of all pairs of columns are less work a row (about nanoseconds) than the models one by one."""
    width = len({c for cols in columns for c in cols}) + 1
    return width * (width + 1) / 2 * (1 + len(columns) / 15) < sum(len(c) ** 2 / 8 + 3 * len(c) + 30 for c in columns)


def _cross(X: np.ndarray, w: np.ndarray) -> np.ndarray:
    return X.T @ (w[:, None] * X)


def _corrected(base: np.ndarray | None, X: np.ndarray, w: np.ndarray, was: np.ndarray | None, now: np.ndarray) -> np.ndarray:
    """``X' diag(w) X`` over the rows ``now`` from ``base``, that over the rows
    ``was``: only rows that differ are added or taken off, if they are the fewer."""
    if was is not None:
        changed = np.flatnonzero(was != now)
        if len(changed) == 0:
            return base
        if 2 * len(changed) < np.count_nonzero(now):
            return base + _cross(X[changed], np.where(now[changed], w[changed], -w[changed]))
    return _cross(X[now], w[now])


def _hinge_sums(X: np.ndarray, t: np.ndarray, w: np.ndarray, fold: np.ndarray | None,
                models: Sequence[tuple[float, int | None, np.ndarray | None]]) -> list[np.ndarray | None]:
    """``_partials`` of squared-hinge models that share rows and design columns.

    ``models``: (cost, fold left out, coefficients); the sums come in their order.
    Models of one cost differ little in their active rows, and so do those of
    neighbouring costs.  One model of each cost has its cross products summed
    fold by fold, from those of the cost before; the others take the folds that
    they keep and correct them on the rows where their own activity differs.
    The sums are those of each model's own active rows, however many differ.
    """
    upper = np.triu_indices(X.shape[1])
    if fold is None:
        slices, names = [slice(0, len(t))], np.array([np.nan])
    else:  # rows by fold; those without one are never left out
        order = np.argsort(fold, kind="stable")
        X, t, w, fold = X[order], t[order], w[order], fold[order]
        names, at = np.unique(fold, return_index=True)
        slices = [slice(a, b) for a, b in zip(at, [*at[1:], len(t)])]
    starts, weights = [s.start for s in slices], np.array([w[s].sum() for s in slices])
    fresh = [i for i, m in enumerate(models) if m[2] is None]
    known = [i for i, m in enumerate(models) if m[2] is not None]
    out: dict[int, np.ndarray] = {}

    def emit(i: int, G: np.ndarray, b: np.ndarray, dev: float, n: float) -> None:
        out[i] = np.concatenate([G[upper], b, [dev, n]])

    if fresh:  # all rows are active
        grams = [_cross(X[s], w[s]) for s in slices]
        sums = [(t[s] * w[s]) @ X[s] for s in slices]
        for i in fresh:
            keep = [f for f, name in enumerate(names) if name != models[i][1]]
            if keep:
                n = float(weights[keep].sum())
                emit(i, sum(grams[f] for f in keep), sum(sums[f] for f in keep), n, n)
    if known:
        margin = 1.0 - t * (np.array([np.nan_to_num(models[i][2]) for i in known]) @ X.T)
        active = margin > 0
        margin[~active] = 0.0
        margin *= margin
        margin *= w
        devs = np.add.reduceat(margin, starts, axis=1)
        kept = names[None, :] != np.array([np.nan if models[i][1] is None else models[i][1] for i in known])[:, None]
        reached = np.where(active, t * w, 0.0)
        for r, f in zip(*np.nonzero(~kept)):
            reached[r, slices[f]] = 0.0
        bs = reached @ X
        last: tuple[list[np.ndarray], np.ndarray] | None = None
        by_cost: dict[float, list[int]] = {}
        for r, i in enumerate(known):
            by_cost.setdefault(models[i][0], []).append(r)
        for _, members in sorted(by_cost.items()):
            ref = active[members[0]]
            grams = [_corrected(None if last is None else last[0][f], X[s], w[s], None if last is None else last[1][s], ref[s])
                     for f, s in enumerate(slices)]
            whole = sum(grams)
            last = grams, ref
            for r in members:
                left = np.flatnonzero(~kept[r])
                if len(left) == len(slices):
                    continue
                own, base = active[r], whole
                if len(left):
                    f = left[0]
                    own = own.copy()
                    own[slices[f]] = ref[slices[f]]  # its rows count neither here nor there
                    base = sum(g for h, g in enumerate(grams) if h != f)
                changed = np.flatnonzero(own != ref)
                if len(changed):
                    base = base + _cross(X[changed], np.where(own[changed], w[changed], -w[changed]))
                emit(known[r], base, bs[r], float(devs[r][kept[r]].sum()), float(weights[kept[r]].sum()))
    return [out.get(i) for i in range(len(models))]  # none where all rows are left out


#: Numbers in one row of a task's sums.
CHUNK = 1 << 16


def _numbers(batch: pa.RecordBatch, names: Sequence[str]) -> dict[str, np.ndarray]:
    """Columns of a batch as doubles, NULL as NaN."""
    return {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names}


def _summed(df: DataFrame, columns: Sequence[str], size: int, add: Callable[[dict[str, np.ndarray], np.ndarray], None]) -> np.ndarray:
    """Sum over all rows of a vector of ``size`` numbers: ``add(columns of a
    batch, vector)`` adds a batch's part, in the tasks."""
    names = list(dict.fromkeys(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, used = np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                used = True
                add(_numbers(batch, names), total)
        if used:
            starts = np.arange(0, size, CHUNK)
            ends = np.append(starts, size).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(starts), dtype=np.int32)), pa.array(np.full(len(starts), TaskContext.get().partitionId(), np.int32)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(total))], ["chunk", "part", "v"])

    schema = "chunk int, part int, v array<double>"

    def together(table: pa.Table) -> pa.Table:
        lists = table.column("v").combine_chunks()
        v = lists.flatten().to_numpy().reshape(len(lists), -1).sum(0)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "part": table.column("part").slice(0, 1),
                         "v": pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v))})

    parts = df.select(*names).mapInArrow(run, schema)
    if df.storageLevel.useMemory and df.rdd.getNumPartitions() > FAN:  # a cached input knows its number of tasks
        parts = parts.groupBy("chunk", F.expr(f"part div {FAN}").alias("branch")).applyInArrow(together, schema)
    chunks = parts.groupBy("chunk").applyInArrow(together, schema).toArrow().sort_by("chunk").column("v").combine_chunks()
    return chunks.flatten().to_numpy() if len(chunks) else np.zeros(size)


def _bases(X: np.ndarray, models: Sequence[tuple[list[int], tuple | None]]) -> Callable[[int, np.ndarray], np.ndarray]:
    """Design columns (with an intercept) of model ``i`` on some rows of a batch;
    a Fourier map is computed once for all its models."""
    whole = np.hstack([np.ones((len(X), 1)), X])
    done: dict[tuple, np.ndarray] = {}

    def of(i: int, at: np.ndarray) -> np.ndarray:
        idx, four = models[i]
        if four is None:
            return whole[np.ix_(at, [0, *[j + 1 for j in idx]])]
        key = tuple(idx), id(four[0])
        if key not in done:
            done[key] = np.hstack([whole[:, :1], _basis(X[:, idx], four)])
        return done[key][at]

    return of


def _shared(specs: Sequence[Spec]) -> list[tuple | None]:
    """Fourier maps of the models, equal ones as one object."""
    seen: dict[str, tuple] = {}
    return [None if s.fourier is None else seen.setdefault(hashlib.md5(s.fourier[0].tobytes() + s.fourier[1].tobytes()).hexdigest(), s.fourier)
            for s in specs]


def _pass(data: Input, specs: Mapping[str, Spec], state: Mapping[str, np.ndarray | None], family: str,
          centre: np.ndarray, scale: np.ndarray) -> dict[str, tuple]:
    """One distributed pass: (G, b, deviance, n) of every candidate at its
    coefficients, over features centred and scaled; none for one without rows."""
    features, keys = data.features, sorted(specs)
    pos = {c: i for i, c in enumerate(features)}
    sizes = [len(specs[k].basis_names()) + 1 for k in keys]
    lengths = [p * (p + 1) // 2 + p + 2 for p in sizes]
    ends = np.cumsum(lengths)
    models = [([pos[c] for c in specs[k].cols], f) for k, f in zip(keys, _shared([specs[k] for k in keys]))]
    # candidates of one row set (include flag, folds, class weights) share its mask and their products;
    # squared-hinge ones those of the same columns
    groups: dict[tuple, list[int]] = {}
    for i, k in enumerate(keys):
        s = specs[k]
        fold = (s.fold_col or data.fold_col) if s.exclude_fold is not None else None
        design = (tuple(models[i][0]), id(models[i][1])) if family == "sqhinge" else None if s.fourier is None else s.exclude_fold
        groups.setdefault((s.include, fold, design, s.class_weights), []).append(i)
    betas, label, weight_col = [state[k] for k in keys], data.label, data.weight_col
    together = {g: family == "binomial" and g[2] is None and _sharing_pays([models[i][0] for i in members]) for g, members in groups.items()}
    left_out, costs = [specs[k].exclude_fold for k in keys], [specs[k].cost or 1.0 for k in keys]
    columns = [*features, label, *([weight_col] if weight_col else []), *[c for g in groups for c in g[:2] if c]]

    def add(cols: dict[str, np.ndarray], total: np.ndarray) -> None:
        y = cols[label]
        X = (np.column_stack([cols[c] for c in features]) - centre) / scale if features else np.zeros((len(y), 0))
        basis, whole = _bases(X, models), bool(np.isfinite(X).all())  # an unknown value is lost to the models of its column only
        wt = cols[weight_col] if weight_col else np.ones(len(y))
        for group, members in groups.items():
            include, fold, _, weights = group
            at = np.flatnonzero(np.ones(len(y), bool) if include is None else cols[include] == 1)
            if not len(at):
                continue
            ym, wm, folds = y[at], wt[at], cols[fold][at] if fold else None
            if weights is not None:
                wm = wm * np.where(ym == 1, weights[1], weights[0])
            if family == "sqhinge":
                found = _hinge_sums(basis(members[0], at), 2.0 * ym - 1.0, wm, folds, [(costs[i], left_out[i], betas[i]) for i in members])
            elif together[group] and whole and len(at) >= BLOCK:  # a small batch is as soon done one by one
                found = _binomial_sums(np.hstack([np.ones((len(at), 1)), X[at]]), ym, wm, folds,
                                       [([0, *[j + 1 for j in models[i][0]]], left_out[i], betas[i]) for i in members])
            else:
                found = [_partials(basis(i, at[keep]), ym[keep], wm[keep], betas[i]) for i in members
                         for keep in [np.ones(len(at), bool) if folds is None else folds != left_out[i]]]
            for i, part in zip(members, found):
                if part is not None:
                    total[ends[i] - lengths[i]:ends[i]] += part

    sums = _summed(data.df, columns, int(ends[-1]), add)
    out = {}
    for i, k in enumerate(keys):
        v, p = sums[ends[i] - lengths[i]:ends[i]], sizes[i]
        if v[-1] > 0:
            G = np.zeros((p, p))
            G[np.triu_indices(p)] = v[:p * (p + 1) // 2]
            out[k] = (np.triu(G, 1).T + G, v[-p - 2:-2], float(v[-2]), float(v[-1]))
    return out


def _kept_columns(G: np.ndarray, tol: float = 1e-11) -> list[int]:
    """Columns of a map of the features that are not linearly dependent on earlier ones."""
    return independent(squared_root(G), math.sqrt(tol))


def _solve(G, b, kept, ridge: float = 0.0):
    Gk = G[np.ix_(kept, kept)].copy()
    if not Gk.any():  # no active row: the coefficients stand
        Gk = np.eye(len(kept))
    if ridge:
        for a, j in enumerate(kept):
            if j != 0:
                Gk[a, a] += ridge
    beta = np.full(len(b), np.nan)
    try:
        beta[kept] = np.linalg.solve(Gk, b[kept])
    except np.linalg.LinAlgError:  # the weights of separated classes vanish
        beta[kept] = np.linalg.lstsq(Gk, b[kept])[0]
    return beta


class Input:
    """A column-pruned copy of the rows that several fits share.

    The copy is cached unless ``df`` is (iterative fits would replay its plan),
    and the factors of row sets are kept, so that all rounds of a search cost
    one caching and one factor pass.  ``with Input(...)`` releases the copy.
    """

    def __init__(self, df: DataFrame, specs: Mapping[str, Spec], label: str, weight_col: str | None = None,
                 fold_col: str | None = None) -> None:
        self.features = sorted({c for s in specs.values() for c in s.cols})
        self.label, self.weight_col, self.fold_col = label, weight_col, fold_col
        extra = sorted({c for s in specs.values() for c in (s.include, s.fold_col or fold_col) if c})
        needed = list(dict.fromkeys([*self.features, label, *([weight_col] if weight_col else []), *extra]))
        self.owned = None
        self.df = df
        if not df.storageLevel.useMemory and not df.storageLevel.useDisk:
            self.df = self.owned = _sized_cache(df.select(*needed))
        self.sets: dict[tuple[str | None, str | None], dict[int, np.ndarray]] = {}

    def __enter__(self) -> Input:
        return self

    def __exit__(self, *_) -> None:
        if self.owned is not None:
            self.owned.unpersist()

    def load(self, specs: Mapping[str, Spec]) -> None:
        """Factors of the row sets of ``specs`` that are not known yet, in one pass."""
        pairs = {(s.include, (s.fold_col or self.fold_col) if s.exclude_fold is not None else None) for s in specs.values()}
        new = {str(i): p for i, p in enumerate(sorted(pairs - set(self.sets), key=str))}
        if new:
            found = factors(self.df, [*self.features, self.label], new, self.weight_col)
            self.sets.update({p: found[i] for i, p in new.items()})

    def factor(self, s: Spec) -> np.ndarray | None:
        """Factor of [1, features, label] over the rows of one candidate."""
        folds = self.sets[s.include, (s.fold_col or self.fold_col) if s.exclude_fold is not None else None]
        parts = [R for k, R in sorted(folds.items()) if s.exclude_fold is None or k != s.exclude_fold]
        return stacked(parts) if parts else None

    def scales(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation of each feature over the rows seen (0 and 1 where there is no spread)."""
        parts = [R for folds in self.sets.values() for R in folds.values()]
        p = len(self.features)
        if not parts:
            return np.zeros(p), np.ones(p)
        R = stacked(parts)
        n = R[:, 0] @ R[:, 0]
        if not n > 0:
            return np.zeros(p), np.ones(p)
        centre = R[:, 0] @ R[:, 1:p + 1] / n
        rest = R[:, 1:p + 1] - np.outer(R[:, 0], centre)
        scale = np.sqrt((rest * rest).sum(0) / n)
        flat = ~(scale > 1e-12 * np.maximum(np.abs(centre), 1e-300))
        return np.where(flat, 0.0, centre), np.where(flat, 1.0, scale)


def fit_many(df: DataFrame | Input, specs: Mapping[str, Spec], label: str, family: str = "binomial",
             weight_col: str | None = None, fold_col: str | None = None, tol: float = 1e-10,
             max_iter: int = 50) -> dict[str, Fit]:
    """Fit every candidate in ``specs``; one Spark job per iteration for all.

    Candidates drop out as they converge (relative deviance/objective change
    below ``tol``), so later jobs carry only the stragglers; one that has not
    after ``max_iter`` is returned with ``converged`` false.  ``df`` may be an
    ``Input`` that earlier fits over the same columns have used.
    """
    if not isinstance(df, Input):
        with Input(df, specs, label, weight_col, fold_col) as data:
            return fit_many(data, specs, label, family, weight_col, fold_col, tol, max_iter)
    alike: dict[tuple, str] = {}
    same = {k: alike.setdefault(s.identity(), k) for k, s in specs.items()}
    if len(alike) < len(specs):  # scenarios that train on the same rows ask for the same models
        fits = fit_many(df, {k: specs[k] for k in alike.values()}, label, family, weight_col, fold_col, tol, max_iter)
        return {k: replace(fits[first], extra=dict(fits[first].extra)) for k, first in same.items()}
    if family == "gaussian":
        df.load(specs)
        return {k: _least_squares_fit(df, s) for k, s in specs.items()}
    return _fit_loop(df, specs, family, tol, max_iter)


def _least_squares_fit(data: Input, s: Spec) -> Fit:
    names, R = [INTERCEPT, *s.basis_names()], data.factor(s)
    if R is None:  # no rows for this candidate
        return _no_rows("gaussian", names, 1)
    pos = {c: i + 1 for i, c in enumerate(data.features)}
    beta, kept, root, rss = least_squares(R[:, [0, *[pos[c] for c in s.cols]]], R[:, -1])
    return Fit("gaussian", names, beta, root, kept, rss, float(R[:, 0] @ R[:, 0]), 1, True, rss)


def _no_rows(family: str, names: list[str], iterations: int) -> Fit:
    return Fit(family, names, np.full(len(names), np.nan), np.eye(1), [], float("nan"), 0.0, iterations, False)


ROWS_PER_PARTITION = 100_000


def _sized_cache(df: DataFrame) -> DataFrame:
    """Cache the pruned input once for all passes, merging partitions so each
    pass runs at most about ``ROWS_PER_PARTITION`` rows per task, in a multiple
    of the cluster's default parallelism (the per-row work is CPU-heavy);
    large inputs keep their partitioning, small ones stop paying one Python
    task per tiny shuffle partition on every iteration."""
    first = df.persist(StorageLevel.MEMORY_AND_DISK)
    n = first.count()
    slots = df.sparkSession.sparkContext.defaultParallelism
    target = max(1, -(-n // (ROWS_PER_PARTITION * slots))) * slots
    if first.rdd.getNumPartitions() <= target:
        return first
    merged = first.coalesce(target).persist(StorageLevel.MEMORY_AND_DISK)
    merged.count()
    first.unpersist()
    return merged


def _fit_loop(data: Input, specs: Mapping[str, Spec], family: str, tol: float, max_iter: int) -> dict[str, Fit]:
    pos = {c: i for i, c in enumerate(data.features)}
    idx = {k: [pos[c] for c in s.cols] for k, s in specs.items()}
    names = {k: [INTERCEPT, *s.basis_names()] for k, s in specs.items()}
    kept_of: dict[str, list[int]] = {}
    centre, scale = np.zeros(len(pos)), np.ones(len(pos))
    if family == "binomial":  # the penalty of a squared hinge depends on the units, so its columns stay as they are
        data.load(specs)
        centre, scale = data.scales()
        for k, s in specs.items():
            R = data.factor(s)
            if R is not None:
                kept_of[k] = independent(R[:, [0, *[i + 1 for i in idx[k]]]])
    # X = Z A for raw X and centred, scaled Z, both with an intercept: A = [[1, centre], [0, scale]]
    move = {}
    for k, s in specs.items():
        A = np.eye(len(names[k]))
        if s.fourier is None:
            A[0, 1:] = centre[idx[k]]
            A[range(1, len(A)), range(1, len(A))] = scale[idx[k]]
        move[k] = A
    state = {k: (None if s.beta0 is None else move[k] @ np.nan_to_num(np.asarray(s.beta0, dtype=float))) for k, s in specs.items()}
    prev = {k: None for k in specs}
    out: dict[str, Fit] = {}
    active = set(specs)
    last: dict[str, tuple] = {}

    def fitted(k: str, beta: np.ndarray, G: np.ndarray, dev: float, n: float, iterations: int, converged: bool) -> Fit:
        kept = kept_of[k]
        raw = np.full(len(beta), np.nan)
        raw[kept] = np.linalg.solve(move[k], np.nan_to_num(beta))[kept]  # aliased ones are 0 in both units
        root = squared_root(G[np.ix_(kept, kept)]) @ move[k][np.ix_(kept, kept)]
        return Fit(family, names[k], raw, root, kept, dev, n, iterations, converged)

    it = 0
    while active and it < max_iter:
        it += 1
        sums = _pass(data, {k: specs[k] for k in active}, state, family, centre, scale)
        for k in sorted(active):
            s = specs[k]
            if k not in sums:  # no rows for this candidate
                out[k] = _no_rows(family, names[k], it)
                active.discard(k)
                continue
            G, b, dev, n = sums[k]
            if k not in kept_of:
                kept_of[k] = _kept_columns(G)
            ridge = 0.0
            if family == "sqhinge":
                ridge = 1.0 / (2.0 * (s.cost or 1.0))
                if state[k] is not None:
                    reg = 0.5 * float(np.sum(np.nan_to_num(state[k][1:]) ** 2))
                    dev = reg + (s.cost or 1.0) * dev
            if state[k] is not None and prev[k] is not None and abs(dev - prev[k]) / (abs(dev) + 0.1) < tol:
                out[k] = fitted(k, state[k], G, dev, n, it, True)
                active.discard(k)
                continue
            prev[k] = dev if state[k] is not None else None
            last[k] = (G, dev, n, state[k] if state[k] is not None else np.full(len(names[k]), np.nan))
            state[k] = _solve(G, b, kept_of[k], ridge)
    for k in active:  # not converged: the coefficients of the last pass, with its information and deviance
        G, dev, n, beta = last[k]
        out[k] = fitted(k, beta, G, dev, n, it, False)
    return out


def score_many(df: DataFrame, models: Mapping[str, tuple[Spec, Fit]], response: bool = False) -> DataFrame:
    """Append one column per model: its linear predictor (decision value),
    or the response with ``response=True`` -- computed on the executors in
    Arrow batches (needed when the basis is a random Fourier map; plain
    models can use ``Fit.eta()`` expressions instead)."""
    names = list(models)
    feats = sorted({c for sp, _ in models.values() for c in sp.cols})
    pos = {c: i for i, c in enumerate(feats)}
    payload = [(n, [pos[c] for c in sp.cols], np.nan_to_num(f.beta), sp.fourier, f.family) for n, (sp, f) in models.items()]
    from pyspark.sql.types import DoubleType, StructField, StructType
    out_schema = StructType([*df.schema.fields, *[StructField(n, DoubleType(), True) for n in names]])

    def run(it):
        for pdf in it:
            X = pdf[feats].to_numpy(dtype=np.float64) if feats else np.zeros((len(pdf), 0))
            ones = np.ones((len(pdf), 1))
            new = {}
            for n, idx, beta, four, fam in payload:
                eta = np.hstack([ones, _basis(X[:, idx], four)]) @ beta
                if response and fam == "binomial":
                    eta = 1.0 / (1.0 + np.exp(-eta))
                new[n] = eta
            yield pd.concat([pdf, pd.DataFrame(new, index=pdf.index)], axis=1)

    return df.mapInPandas(run, out_schema)


@dataclass
class Judged:
    """A model and the rows it is to score: those of the 0/1 column ``rows``
    (all without one).  With ``folds`` each row is scored by the fit that left
    the row's own fold out, and rows without a fold by none.  ``shift`` is
    taken off the linear predictor, and ``response`` makes it a probability."""
    spec: Spec
    fit: Fit | None = None
    rows: str | None = None
    folds: Mapping[int, Fit] | None = None
    fold_col: str | None = None
    shift: float = 0.0
    response: bool = False


def _scorer(models: Sequence[Judged], label: str) -> tuple[list[str], Callable]:
    """Columns needed, and a function from those of a batch to (model, rows, y, score) of each model."""
    features = sorted({c for m in models for c in m.spec.cols})
    pos = {c: i for i, c in enumerate(features)}
    designs = [([pos[c] for c in m.spec.cols], f) for m, f in zip(models, _shared([m.spec for m in models]))]
    betas = [{None: np.nan_to_num(m.fit.beta)} if m.folds is None else {k: np.nan_to_num(f.beta) for k, f in m.folds.items()} for m in models]
    settings = [(m.rows, m.fold_col, m.shift, m.response) for m in models]
    columns = list(dict.fromkeys([*features, label, *[c for m in models for c in (m.rows, m.fold_col if m.folds is not None else None) if c]]))

    def scores(cols: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        y = cols[label]
        basis = _bases(np.column_stack([cols[c] for c in features]) if features else np.zeros((len(y), 0)), designs)
        for i, (rows, fold_col, shift, response) in enumerate(settings):
            wanted = np.ones(len(y), bool) if rows is None else cols[rows] == 1
            for k, beta in betas[i].items():
                mask = wanted if k is None else wanted & (cols[fold_col] == k)
                at = np.flatnonzero(mask)
                if len(at):
                    eta = basis(i, at) @ beta - shift
                    yield i, at, y[at], 1.0 / (1.0 + np.exp(-eta)) if response else eta

    return columns, scores


def score_long(df: DataFrame, models: Sequence[Judged], label: str) -> DataFrame:
    """(model, y, score): a row for each model's index and row it is to score,
    computed in the tasks; no columns are added to the rows."""
    columns, scores = _scorer(models, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for i, at, y, score in scores(_numbers(batch, columns)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(y, from_pandas=True), pa.array(score)],
                                                     ["model", "y", "score"])

    return df.select(*columns).mapInArrow(run, "model int, y double, score double")


def model_sums(df: DataFrame, models: Sequence[Judged], label: str, width: int,
               sums: Callable[[int, np.ndarray, np.ndarray], Sequence[float]]) -> np.ndarray:
    """(models x width): ``sums(model, y, score)`` of every model's rows, added up in the tasks."""
    columns, scores = _scorer(models, label)

    def add(cols: dict[str, np.ndarray], total: np.ndarray) -> None:
        for i, _, y, score in scores(cols):
            total[i * width:(i + 1) * width] += sums(i, y, score)

    return _summed(df, columns, len(models) * width, add).reshape(len(models), width)


def fit(df: DataFrame, features: Sequence[str], label: str, family: str = "binomial",
        weight_col: str | None = None, **kw) -> Fit:
    """A single model (the batch of one)."""
    return fit_many(df, {"m": Spec(tuple(features))}, label, family, weight_col, **kw)["m"]


def norm_sf2(z: float) -> float:
    """Two-sided normal tail probability 2 * (1 - Phi(|z|))."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def odds_ratio(estimate: float) -> float:
    """``exp`` of a coefficient; infinite beyond the doubles, as in R (the intercept of a column far from zero)."""
    try:
        return math.exp(estimate)
    except OverflowError:
        return math.inf


def coefficient_rows(fit_: Fit, model: str = "model") -> list[tuple]:
    """Rows of ``coefficient_table``.

    Errors, statistics and p-values are None where the fit did not converge or
    fitted probabilities reached 0 or 1 (separated data): they mean nothing there.
    """
    sound = fit_.converged and not fit_.separated
    cov = fit_.cov() if sound else None
    rows = []
    for a, i in enumerate(fit_.kept):
        est = float(fit_.beta[i])
        if cov is None:
            rows.append((model, fit_.names[i], est, None, None, None, math.exp(min(est, 700.0)) if fit_.family == "binomial" else None))
            continue
        se = float(math.sqrt(cov[a, a])) if cov[a, a] > 0 else float("nan")
        z = est / se if se and se == se else float("nan")
        if fit_.family == "gaussian":
            p = _t_sf2(z, fit_.n - fit_.rank)
        else:
            p = norm_sf2(z)
        rows.append((model, fit_.names[i], est, se, float(z), float(p),
                     odds_ratio(est) if fit_.family == "binomial" else None))
    return rows


def coefficient_table(spark, fit_: Fit, model: str = "model") -> DataFrame:
    """D10 + G15: estimate, std_error, z (or t), p (Wald), odds_ratio per kept term.

    A p x p-sized result built on the driver from the fit (bounded by the
    number of coefficients, not by data).
    """
    return spark.createDataFrame(coefficient_rows(fit_, model), "model string, term string, estimate double, std_error double, "
                                       "statistic double, p_value double, odds_ratio double")


def _t_sf2(t: float, df: float) -> float:
    """Two-sided Student-t tail via the regularised incomplete beta."""
    if t != t:
        return float("nan")
    x = df / (df + t * t)
    return _betainc(df / 2.0, 0.5, x)


def _betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) (continued fraction, Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(math.log(x) * a + math.log(1 - x) * b + lbeta)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _betainc(b, a, 1 - x)
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = (m * (b - m) * x) / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -((a + m) * (a + b + m) * x) / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + num / c
        c = c if abs(c) > 1e-300 else 1e-300
        cd = c * d
        f *= cd
        if abs(1.0 - cd) < 1e-15:
            break
    return front * (f - 1.0) / a
