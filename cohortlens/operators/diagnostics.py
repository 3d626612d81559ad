"""Model diagnostics.

Per-row diagnostics (fitted, residuals, Cook's distance) are Column expressions
evaluated in codegen on the executors; leverage is a triangular solve per Arrow
batch with the fit's p x p factor, never a row loop.  Tests reduce to one or two
aggregates; the residual autocorrelation uses contiguous row blocks with a
halo of ``max_lag`` rows instead of one global window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.stat import KolmogorovSmirnovTest
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.columns import dnorm, safe_ratio
from cohortlens.operators.glm import Fit, _t_sf2
from cohortlens.operators.ranking import positions, quantiles_type7


def with_fitted(df: DataFrame, fit: Fit, y: str | None = None, prefix: str = "") -> DataFrame:
    """D1 + D2: ``fitted`` (response scale), ``eta`` (link) and ``resid`` = y - fitted."""
    out = df.withColumn(f"{prefix}eta", fit.eta()).withColumn(f"{prefix}fitted", fit.response())
    if y is not None:
        out = out.withColumn(f"{prefix}resid", F.col(y) - F.col(f"{prefix}fitted"))
    return out


def _leverage(fit: Fit) -> Column:
    """x' (X'WX)^-1 x of each row: a triangular solve per Arrow batch with the
    fit's factor, p^2 operations a row whatever p is; only the model's columns
    go to Python."""
    cols = [fit.names[i] for i in fit.kept if i != 0]
    has_intercept, root = 0 in fit.kept, fit.root

    @F.pandas_udf("double")
    def solve(*columns: pd.Series) -> pd.Series:
        n = len(columns[0])
        x = [np.ones(n)] * has_intercept + [c.to_numpy(dtype=np.float64) for c in columns[:len(cols)]]
        half = np.linalg.solve(root.T, np.vstack(x))
        return pd.Series((half * half).sum(0))

    return solve(*[F.col(c).cast("double") for c in cols] or [F.lit(1.0)])


def with_influence(df: DataFrame, fit: Fit, y: str) -> DataFrame:
    """D3: leverage ``h`` and Cook's distance ``cooks_d`` for every row.

    logistic: (r_P / (1 - h))^2 * h / k with r_P the Pearson residual;
    linear: e^2 h / (s^2 k (1 - h)^2).  k = number of kept coefficients.
    Undefined measures (leverage 1, fitted 0 or 1) are NULL.
    """
    out = with_fitted(df, fit, y).withColumn("_q", _leverage(fit))
    q = F.col("_q")
    k = float(fit.rank)
    if fit.family == "binomial":
        mu = F.col("fitted")
        out = out.withColumn("h", mu * (F.lit(1.0) - mu) * q)
        rp = safe_ratio(F.col(y) - mu, F.sqrt(mu * (F.lit(1.0) - mu)))
        out = out.withColumn("pearson", rp)
        cook = F.pow(safe_ratio(rp, F.lit(1.0) - F.col("h")), 2) * F.col("h") / F.lit(k)
    else:
        s2 = fit.deviance / (fit.n - fit.rank)
        out = out.withColumn("h", q)
        cook = safe_ratio(F.pow(F.col("resid"), 2) * F.col("h"), F.lit(s2 * k) * F.pow(F.lit(1.0) - F.col("h"), 2))
    return out.withColumn("cooks_d", cook).drop("_q")


def cooks_cutoff(fit: Fit) -> float:
    """4 / (n - #coefficients - 1), coefficients including the intercept."""
    return 4.0 / (fit.n - len(fit.names) - 1)


def label_influential(df: DataFrame, threshold: float, key: str = "id") -> DataFrame:
    """The row key where Cook's distance exceeds ``threshold``, else ''."""
    return df.withColumn("label", F.when(F.col("cooks_d") > F.lit(float(threshold)),
                                         F.col(key).cast("string")).otherwise(F.lit("")))


def hosmer_lemeshow_bins(df: DataFrame, y: str, fitted: str, g: int = 10) -> DataFrame:
    """D6 (table): observed/expected counts in ``g`` groups cut at the exact
    (type 7) quantiles of the fitted values; right-closed, lowest included."""
    qs = quantiles_type7(df, fitted, [i / g for i in range(g + 1)])
    inner = qs[1:-1]
    x = F.col(fitted)
    b = F.lit(1)
    for q in inner:
        b = b + (x > F.lit(float(q))).cast("int")
    return (df.groupBy(b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("observed"),
                 F.sum(x).alias("expected")))


def chi2_sf_even(x: Column, df: int) -> Column:
    """Upper tail of chi-square with even df: e^{-x/2} sum_{j<df/2} (x/2)^j / j!."""
    h = x / F.lit(2.0)
    s = F.lit(0.0)
    for j in range(df // 2):
        s = s + F.pow(h, F.lit(float(j))) / F.lit(float(math.factorial(j)))
    return F.exp(-h) * s


def hosmer_lemeshow(df: DataFrame, y: str, fitted: str, g: int = 10) -> DataFrame:
    """Hosmer-Lemeshow chi-square over both classes, df = g - 2."""
    bins = hosmer_lemeshow_bins(df, y, fitted, g)
    other = F.col("n") - F.col("expected")
    term = (safe_ratio(F.pow(F.col("observed") - F.col("expected"), 2), F.col("expected"))
            + safe_ratio(F.pow((F.col("n") - F.col("observed")) - other, 2), other))
    out = bins.agg(F.sum(term).alias("chisq"))
    dof = g - 2
    return out.select("chisq", F.lit(dof).alias("df"), chi2_sf_even(F.col("chisq"), dof).alias("p_value"))


def jarque_bera(df: DataFrame, col: str) -> DataFrame:
    """D9 (re-aimed Shapiro-Wilk): JB = n/6 (S^2 + K^2/4), p = exp(-JB/2)."""
    st = df.agg(F.count(col).alias("n"), F.skewness(col).alias("skewness"), F.kurtosis(col).alias("kurtosis"))
    jb = F.col("n") / F.lit(6.0) * (F.pow(F.col("skewness"), 2) + F.pow(F.col("kurtosis"), 2) / F.lit(4.0))
    return st.select("n", "skewness", "kurtosis", jb.alias("jb"), F.exp(-jb / F.lit(2.0)).alias("p_value"))


def ks_normal(df: DataFrame, col: str, standardise: bool = False) -> DataFrame:
    """One-sample Kolmogorov-Smirnov against N(0,1) (optionally after
    standardising with the sample mean/sd), Spark's distributed KS test."""
    src = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull())
    if standardise:
        st = src.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).first()
        src = src.select(((F.col("x") - F.lit(st["m"])) / F.lit(st["s"])).alias("x"))
    r = KolmogorovSmirnovTest.test(src, "x", "norm", 0.0, 1.0).first()
    return df.sparkSession.createDataFrame([(float(r.statistic), float(r.pValue), bool(standardise))],
                                           "statistic double, p_value double, standardised boolean")


def studentised(df: DataFrame, fit: Fit, y: str) -> DataFrame:
    """Externally studentised residual ``rstudent`` of every row of a linear fit
    (NULL where leaving the row out leaves no variance)."""
    n, k = fit.n, fit.rank
    e, h = F.col("resid"), F.col("h")
    left = (F.lit(fit.deviance) - safe_ratio(e * e, F.lit(1.0) - h)) / F.lit(n - k - 1)
    return with_influence(df, fit, y).withColumn("rstudent", F.when(left > 0, safe_ratio(e, F.sqrt(left * (F.lit(1.0) - h)))))


def outlier_test(df: DataFrame, fit: Fit, y: str, key: str = "id", n_max: int = 10) -> DataFrame:
    """D7 + T5: studentised residuals, the ``n_max`` largest in absolute value,
    with unadjusted and Bonferroni p-values (t with n - k - 1 df).

    Only the top ``n_max`` rows reach the driver (TakeOrdered), where their
    p-values are computed.
    """
    n, k = fit.n, fit.rank
    rs = studentised(df, fit, y)
    top = rs.orderBy(F.desc(F.abs("rstudent"))).limit(n_max).select(key, "rstudent").collect()
    rows = []
    for r in top:
        p = _t_sf2(float(r["rstudent"]), n - k - 1)
        rows.append((r[key], float(r["rstudent"]), float(p), float(min(1.0, n * p))))
    return df.sparkSession.createDataFrame(rows, f"{key} long, rstudent double, p_unadjusted double, "
                                                 "p_bonferroni double")


def acf(df: DataFrame, col: str, order_col: str, max_lag: int | None = None, block: int = 100000) -> DataFrame:
    """``acf(x)`` -- autocorrelation for lags 0..floor(10 log10 n), biased
    (common denominator), series in ``order_col`` order.

    Dense positions come from ranges of the order; rows are cut into contiguous
    blocks of ``block`` rows and each block also receives the last
    ``max_lag`` rows of the previous block (halo), so every lag product is a
    window ``lag`` inside one block.  Data copied: a factor 1 + max_lag/block.
    """
    src = df.select(F.col(order_col).alias("_o"), F.col(col).cast("double").alias("_x")).where(
        F.col("_x").isNotNull())
    st = src.agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("m")).first()
    n, mean = int(st["n"]), float(st["m"])
    L = max_lag if max_lag is not None else int(math.floor(10 * math.log10(n)))
    L = min(L, n - 1)
    pos = positions(src, ["_o"], "_i")
    xc = pos.withColumn("_c", F.col("_x") - F.lit(mean)).withColumn("_b", F.floor(F.col("_i") / block))
    halo = (xc.where(F.pmod(F.col("_i"), F.lit(block)) >= block - L)
            .withColumn("_b", F.col("_b") + 1).withColumn("_h", F.lit(True)))
    body = xc.withColumn("_h", F.lit(False))
    w = Window.partitionBy("_b").orderBy("_i")
    both = body.unionByName(halo)
    lagged = both.select("_h", *[(F.col("_c") * F.coalesce(F.lag("_c", k).over(w), F.lit(0.0))).alias(f"l{k}")
                                 for k in range(1, L + 1)], (F.col("_c") * F.col("_c")).alias("l0"))
    sums = lagged.where(~F.col("_h")).agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(L + 1)])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"l{k}") / F.col("l0")).alias("acf"))
                     for k in range(L + 1)])
    return sums.select(F.inline(rows))


def density_overlay(df: DataFrame, col: str, lo: int = -40, hi: int = 40) -> DataFrame:
    """``dnorm(seq(lo, hi, 1), mean(x), sd(x))`` as rows (x, density)."""
    st = df.agg(F.avg(col).alias("m"), F.stddev_samp(col).alias("s"))
    return st.select(F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("x"), "m", "s").select(
        F.col("x"), dnorm(F.col("x").cast("double"), F.col("m"), F.col("s")).alias("density"))


def qq_points(df: DataFrame, col: str) -> DataFrame:
    """(theoretical, sample) QQ points: i-th smallest value against the
    normal quantile of ``ppoints(n)``; ranks come from ranges of the values
    (``ranking.positions``), the inverse normal CDF is a rational approximation evaluated as a Column expression."""
    src = df.select(F.col(col).cast("double").alias("sample")).where(F.col("sample").isNotNull())
    n = src.count()
    a = 3.0 / 8.0 if n <= 10 else 0.5
    i = F.col("_i") + 1
    p = (i - F.lit(a)) / F.lit(n + 1 - 2 * a)
    return positions(src, ["sample"], "_i").select(i.alias("i"), qnorm(p).alias("theoretical"), "sample")


# Coefficients of Acklam's approximation.
QNORM_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
           1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
QNORM_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
           6.680131188771972e+01, -1.328068155288572e+01]
QNORM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
           -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
QNORM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]


def qnorm(p: Column) -> Column:
    """Inverse standard normal CDF (Acklam's rational approximation,
    relative error < 1.2e-9) as a native Column expression."""
    a, b, c, d = QNORM_A, QNORM_B, QNORM_C, QNORM_D

    def poly(coefs, x):
        e = F.lit(coefs[0])
        for k in coefs[1:]:
            e = e * x + F.lit(k)
        return e

    plow = 0.02425
    q_lo = F.sqrt(F.lit(-2.0) * F.ln(p))
    lo = poly(c, q_lo) / (poly(d, q_lo) * q_lo + F.lit(1.0))
    q = p - F.lit(0.5)
    r = q * q
    mid = poly(a, r) * q / (poly(b, r) * r + F.lit(1.0))
    q_hi = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - p))
    hi = -poly(c, q_hi) / (poly(d, q_hi) * q_hi + F.lit(1.0))
    return F.when(p < F.lit(plow), lo).when(p > F.lit(1 - plow), hi).otherwise(mid)
