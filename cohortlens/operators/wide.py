"""Models with one factor of any number of levels (M7, G1, G5 at scale).

A dummy column a level costs a dense row of the information matrix each.  Here
a factor is an index column and its coefficients are a table with a row for each
level, distributed like any other; the few dense columns stay on the driver.
Within the information matrix the factor's block is diagonal, so it is
eliminated exactly: with d, r and B the sums of w, w z and w x over a level's
rows, the dense coefficients solve

    (sum w x x' - sum_levels B B' / d) b = sum w x z - sum_levels B r / d

and each level's is (r - B' b) / d.  A Newton step is one aggregate by level (a
partial sum in every task first, so a level with most of the rows is no hot task),
one aggregate of the level table into p^2 numbers, and a projection of it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.factor import independent, squared_root
from cohortlens.session import materialize


@dataclass
class WideFit:
    """``columns``: (name, estimate, std_error) of the dense columns, NaN where aliased;
    ``levels``: DataFrame (level, n, estimate, std_error); a level whose labels are all
    alike has no finite estimate (NULL), predicts its rows without error and
    takes no part in the dense ones."""
    family: str
    columns: list[tuple[str, float, float]]
    levels: DataFrame
    n: int
    n_levels: int
    separated: int
    deviance: float
    iterations: int
    converged: bool

    @property
    def rank(self) -> int:
        return self.n_levels + sum(not np.isnan(b) for _, b, _ in self.columns)

    def aic(self) -> float:
        if self.family == "gaussian":
            return self.n * float(np.log(self.deviance / self.n)) + 2 * self.rank
        return self.deviance + 2 * self.rank


def _level_sums(rows: DataFrame, p: int, w: Column, z: Column, dev: Column) -> DataFrame:
    """Sums by level; ``w``, ``z`` and ``dev`` are the weight, working response and deviance of a row."""
    x = [F.col(f"x{j}") for j in range(p)]
    rows = rows.withColumns({"w": w, "z": z, "dev": dev})
    w, z = F.col("w"), F.col("z")
    return rows.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("d"), F.sum(w * z).alias("r"), F.sum("dev").alias("dev"),
        *[F.sum(w * x[j]).alias(f"b{j}") for j in range(p)], *[F.sum(w * x[j] * z).alias(f"c{j}") for j in range(p)],
        *[F.sum(w * x[j] * x[k]).alias(f"a{j}_{k}") for j in range(p) for k in range(j, p)], F.sum(w * z * z).alias("zz"))


def _dense(levels: DataFrame, p: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Information and right-hand side of the dense columns with the levels eliminated, deviance, and what of z the levels leave."""
    d, r = F.col("d"), F.col("r")
    row = levels.agg(
        F.sum("dev").alias("dev"), F.sum(F.col("zz") - r * r / d).alias("left"),
        *[F.sum(F.col(f"c{j}") - F.col(f"b{j}") * r / d).alias(f"c{j}") for j in range(p)],
        *[F.sum(F.col(f"a{j}_{k}") - F.col(f"b{j}") * F.col(f"b{k}") / d).alias(f"a{j}_{k}") for j in range(p) for k in range(j, p)]).first()
    S = np.zeros((p, p))
    for j in range(p):
        for k in range(j, p):
            S[j, k] = S[k, j] = row[f"a{j}_{k}"] or 0.0
    return S, np.array([row[f"c{j}"] or 0.0 for j in range(p)]), float(row["dev"] or 0.0), float(row["left"] or 0.0)


def _of_level(b: np.ndarray) -> Column:
    """A level's coefficient, given those of the dense columns."""
    rest = F.col("r")
    for j, v in enumerate(b):
        rest = rest - F.lit(float(v)) * F.col(f"b{j}")
    return rest / F.col("d")


def fit_wide(df: DataFrame, factor: str, columns: Sequence[str], label: str, family: str = "binomial",
             tol: float = 1e-10, max_iter: int = 50) -> WideFit:
    """``label ~ factor + columns`` with a coefficient for every level (no intercept).

    Rows with a NULL in any of them are left out.  ``columns`` are few: the
    driver holds their p x p system, whatever the number of levels.
    """
    p = len(columns)
    rows = df.select(F.col(factor).alias("level"), F.col(label).cast("double").alias("y"),
                     *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)]).dropna()
    means = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{j}").alias(f"x{j}") for j in range(p)]).first()
    centre = np.array([means[f"x{j}"] or 0.0 for j in range(p)])
    rows = materialize(rows.withColumns({f"x{j}": F.col(f"x{j}") - F.lit(float(m)) for j, m in enumerate(centre)}) if p else rows)
    if family == "gaussian":
        levels = materialize(_level_sums(rows, p, F.lit(1.0), F.col("y"), F.lit(0.0)))
        S, c, _, left = _dense(levels, p)
        b, kept, inverse = _solved(S, c)
        n_levels = levels.count()
        rss = max(left - float(b @ c), 0.0)
        spread = rss / max(means["n"] - n_levels - len(kept), 1)
        return _wide(family, columns, kept, b, inverse * spread, spread, levels.withColumn("estimate", _of_level(b)), centre, means["n"], n_levels, 0, rss, 1, True, None)
    counts = materialize(rows.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")))
    mixed = (F.col("s") > 0) & (F.col("s") < F.col("n"))
    n_levels, separated = counts.agg(F.count(F.lit(1)), F.count_if(~mixed)).first()
    state = counts.where(mixed).select("level", F.ln(F.col("s") / (F.col("n") - F.col("s"))).alias("a"))
    b, last, it, converged = np.zeros(p), None, 0, False
    while True:
        it += 1
        eta = F.col("a")
        for j, v in enumerate(b):
            eta = eta + F.lit(float(v)) * F.col(f"x{j}")
        now = rows.join(state, "level").withColumn("eta", eta).withColumn("mu", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("eta"))))
        mu, w = F.col("mu"), F.col("mu") * (F.lit(1.0) - F.col("mu"))
        # log(1 + exp(eta)) - y eta, for either sign of eta
        loss = F.greatest(F.col("eta"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("eta"))) - F.col("y") * F.col("eta")
        levels = materialize(_level_sums(now, p, w, F.col("eta") + (F.col("y") - mu) / w, F.lit(2.0) * loss))
        S, c, dev, _ = _dense(levels, p)
        new, kept, inverse = _solved(S, c)
        if last is not None and abs(dev - last) / (abs(dev) + 0.1) < tol:
            converged = True
            break
        if it >= max_iter:
            break
        last, b = dev, new
        state = levels.select("level", _of_level(b).alias("a"))
    finished = levels.join(state, "level").withColumnRenamed("a", "estimate")
    return _wide(family, columns, kept, b, inverse, 1.0, finished, centre, means["n"], n_levels, separated, dev, it, converged, counts.where(~mixed))


def _solved(S: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Coefficients (0 where aliased), kept columns and the inverse information among all."""
    kept = independent(squared_root(S), 1e-6) if len(c) else []  # S holds squares, so half the digits tell
    b, inverse = np.zeros(len(c)), np.zeros((len(c), len(c)))
    if kept:
        inverse[np.ix_(kept, kept)] = np.linalg.inv(S[np.ix_(kept, kept)])
        b = inverse @ c
    return b, kept, inverse


def _wide(family, columns, kept, b, inverse, spread, levels, centre, n, n_levels, separated, deviance, it, converged, others) -> WideFit:
    # a level's estimate is that of the mean row; in raw units the columns' means are taken off again
    estimate = F.col("estimate") - F.lit(float(centre @ b))
    variance = F.lit(float(spread)) / F.col("d")
    moved = [F.col(f"b{j}") / F.col("d") + F.lit(float(centre[j])) for j in range(len(columns))]
    for j in kept:
        for k in kept:
            variance = variance + F.lit(float(inverse[j, k])) * moved[j] * moved[k]
    table = levels.select("level", "n", estimate.alias("estimate"), F.sqrt(variance).alias("std_error"))
    if others is not None:
        none = F.lit(None).cast("double")
        table = table.unionByName(others.select("level", "n", none.alias("estimate"), none.alias("std_error")))
    dense = [(name, float(b[j]) if j in kept else float("nan"), float(np.sqrt(inverse[j, j])) if j in kept else float("nan")) for j, name in enumerate(columns)]
    return WideFit(family, dense, table, int(n), int(n_levels), int(separated), float(deviance), it, converged)
