"""Triangular factors of tall design matrices (the core of G1, G5, G6, G9).

A cross-product matrix squares the condition of its columns: a column of mean
1e6 and deviation 1 looks dependent on the intercept.  A QR factor does not.
Each task reduces its Arrow batches to one small triangle per row set by
stacking them on the triangle so far (tall-skinny QR, Demmel et al. 2012), and
triangles are merged as a tree of groups of ``FAN``, since the triangle of
stacked triangles is that of all their rows.  Every subset of columns, and every
union of row sets (all folds but one), is then a small problem on the driver:
``R[:, cols]`` stands for the columns, and stacked factors for the union.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Triangles that one task merges, on each of two levels.
FAN = 256
#: A column is dependent on earlier ones when this share of its length, or less, is left outside their span.
TOL = 1e-9


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of the QR factorisation; fewer rows than columns stay as they are."""
    return np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows


def stacked(factors: Sequence[np.ndarray]) -> np.ndarray:
    """The factor of the union of disjoint row sets."""
    return triangle(np.vstack(list(factors)))


def independent(A: np.ndarray, tol: float = TOL) -> list[int]:
    """Columns of ``A`` not dependent on earlier kept ones, in their order (R reports the others as NA)."""
    kept: list[int] = []
    basis = np.zeros((len(A), 0))
    for j in range(A.shape[1]):
        column = A[:, j]
        length = np.linalg.norm(column)
        if not length > 0:
            continue
        rest = column / length
        for _ in range(2):  # once more removes what rounding left
            rest = rest - basis @ (basis.T @ rest)
        left = np.linalg.norm(rest)
        if left > tol:
            kept.append(j)
            basis = np.column_stack([basis, rest / left])
    return kept


def least_squares(A: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray, float]:
    """Coefficients (NaN where dependent), kept columns, their triangle, residual sum of squares."""
    kept = independent(A)
    beta = np.full(A.shape[1], np.nan)
    q, root = np.linalg.qr(A[:, kept])
    beta[kept] = np.linalg.solve(root, q.T @ y)
    rest = y - A[:, kept] @ beta[kept]
    return beta, kept, root, float(rest @ rest)


def squared_root(G: np.ndarray) -> np.ndarray:
    """An upper triangle whose cross product is ``G``, also where rounding makes it indefinite."""
    try:
        return np.linalg.cholesky(G).T
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(G)
        return np.linalg.qr(np.sqrt(np.maximum(values, 0.0))[:, None] * vectors.T, mode="r")


def factors(df: DataFrame, columns: Sequence[str], sets: Mapping[str, tuple[str | None, str | None]],
            weight_col: str | None = None) -> dict[str, dict[int, np.ndarray]]:
    """Factors of ``[1, columns]`` for several row sets in one pass.

    ``sets``: name -> (0/1 include column or None, fold column or None).  Gives
    name -> {fold: factor}, fold 0 where the set has no folds; rows without a
    fold are left out of a set that has folds.  A row may be in many sets.
    """
    names, cols = sorted(sets), list(columns)
    aux = sorted({c for pair in sets.values() for c in pair if c})
    needed = list(dict.fromkeys([*cols, *([weight_col] if weight_col else []), *aux]))
    width = len(cols) + 1
    if not needed:
        df, needed = df.withColumn("_none", F.lit(0)), ["_none"]

    def run(batches):
        from pyspark import TaskContext

        acc: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            Z = np.hstack([np.ones((len(pdf), 1)), pdf[cols].to_numpy(dtype=np.float64)])
            if weight_col:
                Z = Z * np.sqrt(pdf[weight_col].to_numpy(dtype=np.float64))[:, None]
            for i, name in enumerate(names):
                include, fold = sets[name]
                mask = pdf[include].to_numpy() == 1 if include else np.ones(len(pdf), bool)
                keys = pdf[fold].to_numpy(dtype=np.float64) if fold else np.zeros(len(pdf))
                for k in np.unique(keys[mask & ~np.isnan(keys)]):
                    part = Z[mask & (keys == k)]
                    key = i, int(k)
                    acc[key] = triangle(part if key not in acc else np.vstack([acc[key], part]))
        if acc:
            yield pd.DataFrame({"s": [i for i, _ in acc], "fold": [k for _, k in acc], "part": TaskContext.get().partitionId(),
                                "v": [a.ravel().tolist() for a in acc.values()]})

    schema = "s int, fold int, part int, v array<double>"

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = np.zeros((0, width))
        for v in pdf["v"]:
            whole = triangle(np.vstack([whole, np.asarray(v, float).reshape(-1, width)]))
        return pd.DataFrame({"s": pdf["s"].iloc[:1], "fold": pdf["fold"].iloc[:1], "part": 0, "v": [whole.ravel().tolist()]})

    parts = df.select(*needed).mapInPandas(run, schema)
    merged = parts.groupBy("s", "fold", F.expr(f"part div {FAN}").alias("branch")).applyInPandas(merge, schema)
    out: dict[str, dict[int, np.ndarray]] = {n: {} for n in names}
    for r in merged.groupBy("s", "fold").applyInPandas(merge, schema).collect():  # one triangle a set and fold
        out[names[r["s"]]][r["fold"]] = np.asarray(r["v"], float).reshape(-1, width)
    return out
