"""Column profiles: nulls, correlations, summaries, histograms.

Each profile is one aggregate pass producing one wide row, then an
``unpivot`` to a long (column, statistic) table -- never a loop of jobs per
column.  Exact quantiles use radix selection (``ranking``) instead of
Spark's ``percentile``, which buffers a whole group in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.ranking import quantiles_type7_many


def null_profile(df: DataFrame, columns: Sequence[str] | None = None, min_nulls: int = -1) -> DataFrame:
    """A4: NULL count per column, keeping columns with more than ``min_nulls``."""
    cols = list(columns or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column", "n_null")
    return long.where(F.col("n_null") > F.lit(min_nulls))


def class_counts(df: DataFrame, label: str = "final") -> DataFrame:
    """A5: rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def correlation_with(df: DataFrame, columns: Sequence[str], y: str, complete: bool = True,
                     digits: int = 9) -> DataFrame:
    """``cor(x, y, use="complete.obs")`` -- listwise complete, one pass."""
    cols = list(columns)
    src = df.dropna(subset=[*cols, y]) if complete else df
    wide = src.agg(*[F.round(F.corr(c, y), digits).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "r")


def correlation_matrix(df: DataFrame, columns: Sequence[str], complete: bool = True,
                       digits: int = 9) -> DataFrame:
    """Listwise-complete correlation matrix as long (a, b, r), both
    orders and the unit diagonal; the p(p-1)/2 ``corr`` aggregates share
    one scan."""
    cols = list(columns)
    src = df.dropna(subset=cols) if complete else df
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = src.agg(*[F.round(F.corr(a, b), digits).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    entries = []
    for i, (a, b) in enumerate(pairs):
        for x, z in ((a, b), (b, a)):
            entries.append(F.struct(F.lit(x).alias("a"), F.lit(z).alias("b"), F.col(f"{i}").alias("r")))
    for a in cols:
        entries.append(F.struct(F.lit(a).alias("a"), F.lit(a).alias("b"), F.lit(1.0).alias("r")))
    return wide.select(F.inline(F.array(*entries)))


def mean_sd(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and sample sd per column, long form."""
    cols = list(columns)
    wide = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                  *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("sd"))
                     for i, c in enumerate(cols)])
    return wide.select(F.inline(rows))


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A13 (numeric): min, Q1, median, mean, Q3, max, NULL count per column.

    Quartiles are R type 7, found exactly by radix selection (a few counting
    passes shared by all columns), so no task holds a whole column.
    """
    spark = df.sparkSession
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))  # noqa: E731  the selection skips NaN too
    base = df.agg(*[F.count_if(known(c)).alias(f"n{i}") for i, c in enumerate(columns)],
                  *[F.count_if(F.col(c).isNull()).alias(f"z{i}") for i, c in enumerate(columns)],
                  *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    counts = {c: base[f"n{i}"] for i, c in enumerate(columns)}
    qs_all = quantiles_type7_many(df, {c: [0.0, 0.25, 0.5, 0.75, 1.0] for c in columns if counts[c]}, counts)
    rows = []
    for i, c in enumerate(columns):
        qs = qs_all.get(c, [None] * 5)
        rows.append((c, qs[0], qs[1], qs[2], base[f"m{i}"], qs[3], qs[4], int(base[f"z{i}"])))
    schema = ("column string, min double, q1 double, median double, mean double, q3 double, "
              "max double, n_null long")
    return spark.createDataFrame(rows, schema)


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A13 (factors): count per level of each category column, long form.

    One pass: the columns are stacked into (column, level) pairs and counted
    by a single partial+final aggregate.
    """
    cols = list(columns)
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                                     F.col(c).cast("string").alias("level")) for c in cols]))
                        .alias("s")).select("s.*")
    return stacked.groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ histogram

def pretty(lo: float, hi: float, n: int, min_n: int | None = None, shrink_sml: float = 0.75,
           high_u_bias: float = 1.5) -> list[float]:
    """R's ``pretty()`` break points (the public algorithm, default biases)."""
    ns, nu, unit, k = pretty_bounds(lo, hi, n, min_n, shrink_sml, high_u_bias)
    lo_b, hi_b = ns * unit, nu * unit
    return [lo_b + (hi_b - lo_b) * i / k for i in range(k + 1)] if k else [lo_b]


def pretty_bounds(lo: float, hi: float, n: int, min_n: int | None = None, shrink_sml: float = 0.75,
                  high_u_bias: float = 1.5) -> tuple[int, int, float, int]:
    """(ns, nu, unit, k) of ``pretty()``: breaks are ns*unit .. nu*unit, k bins."""
    u5_bias = 0.5 + 1.5 * high_u_bias
    min_n = n // 3 if min_n is None else min_n
    eps = 1e-10
    dx = hi - lo
    if dx == 0 and hi == 0:
        cell, small = 1.0, True
    else:
        cell = max(abs(lo), abs(hi))
        u = 1 + (1 / (1 + high_u_bias) if u5_bias >= 1.5 * high_u_bias + 0.5 else 1.5 / (1 + u5_bias))
        u *= max(1, n) * 2.220446049250313e-16
        small = dx < cell * u * 3
    if small:
        if cell > 10:
            cell = 9 + cell / 10
        cell *= shrink_sml
        if min_n > 1:
            cell /= min_n
    else:
        cell = dx
        if n > 1:
            cell /= n
    cell = max(cell, 2.0 ** -20 * 2.2250738585072014e-308)
    base = 10.0 ** math.floor(math.log10(cell))
    unit = base
    if 2 * base - cell < high_u_bias * (cell - unit):
        unit = 2 * base
        if 5 * base - cell < u5_bias * (cell - unit):
            unit = 5 * base
            if 10 * base - cell < high_u_bias * (cell - unit):
                unit = 10 * base
    ns = math.floor(lo / unit + eps)
    nu = math.ceil(hi / unit - eps)
    while ns * unit > lo + eps * unit:
        ns -= 1
    while nu * unit < hi - eps * unit:
        nu += 1
    k = int(0.5 + nu - ns)
    if k < min_n:
        k = min_n - k
        if ns >= 0:
            nu += k // 2
            ns -= k // 2 + k % 2
        else:
            ns -= k // 2
            nu += k // 2 + k % 2
        k = min_n
    return int(ns), int(nu), unit, k


def density_histogram(df: DataFrame, col: str) -> DataFrame:
    """``hist(x, probability=TRUE)`` -- Sturges + pretty breaks,
    right-closed bins with the lowest included, density = count / (n * width).

    One aggregate for (n, min, max), breaks on the driver (a handful of
    numbers), one grouped count for the bins.
    """
    st = df.agg(F.count(col).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    ns, _, width, _ = pretty_bounds(float(st["lo"]), float(st["hi"]), int(math.ceil(math.log2(st["n"]) + 1)), 1)
    lo = ns * width
    fuzz = 1e-7 * width
    x = F.col(col).cast("double")
    b = F.greatest(F.lit(1), F.ceil((x - F.lit(lo) - F.lit(fuzz)) / F.lit(width))).cast("int")
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(
        "bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("lower"),
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("upper"), "count",
        (F.col("count") / (F.lit(float(st["n"])) * F.lit(width))).alias("density"))


def simple_regression_line(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """``abline(lm(y ~ x))`` for each x: slope and intercept, one pass."""
    cols = list(xs)
    wide = df.agg(*[F.regr_slope(F.col(y), F.col(x)).alias(f"b{i}") for i, x in enumerate(cols)],
                  *[F.regr_intercept(F.col(y), F.col(x)).alias(f"a{i}") for i, x in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(x).alias("x"), F.col(f"b{i}").alias("slope"), F.col(f"a{i}").alias("intercept"))
                     for i, x in enumerate(cols)])
    return wide.select(F.inline(rows))
