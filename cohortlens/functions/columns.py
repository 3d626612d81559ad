"""Scalar Column expressions (§2.12 of the survey).

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so
it stays inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tolerant_double(c) -> Column:
    """``as.numeric(as.character(x))``: unparsable text becomes NULL."""
    return _c(c).try_cast("double")


def as_category(c) -> Column:
    """``as.factor(x)``: categories are strings until model time."""
    return _c(c).cast("string")


def pass_label(c, mark: float = 50.0) -> Column:
    """``ifelse(Final >= mark, 1, 0)`` with NULL kept NULL."""
    col = _c(c)
    return F.when(col.isNotNull(), (col >= F.lit(float(mark))).cast("int"))


def order_key(c, seed) -> Column:
    """Deterministic pseudo-random order key: md5('<seed>:' || id).

    Identical strings on Spark and DuckDB, so split/fold/sample membership is
    reproducible across engines and independent of partitioning.
    """
    return F.md5(F.concat(F.lit(f"{seed}:"), _c(c).cast("string")))


def round_half_even(c, digits: int = 0) -> Column:
    """``round(x, digits)`` of IEEE arithmetic: a half goes to the even neighbour."""
    return F.bround(_c(c), digits)


def first_match(c, pattern: str) -> Column:
    """``grep(pattern, x)[1]``: the first element of an array that matches, NULL if none does."""
    return F.get(F.filter(_c(c), lambda x: x.rlike(pattern)), 0)


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def logit(p) -> Column:
    p = _c(p)
    return F.ln(p / (F.lit(1.0) - p))


def dnorm(x, mean, sd) -> Column:
    """Normal density with Column or float mean/sd."""
    x = _c(x)
    m = mean if isinstance(mean, Column) else F.lit(float(mean))
    s = sd if isinstance(sd, Column) else F.lit(float(sd))
    z = safe_ratio(x - m, s)  # sd 0: no density, NULL
    return safe_ratio(F.exp(F.lit(-0.5) * z * z), s * F.lit(math.sqrt(2.0 * math.pi)))


def linear_predictor(coefs: Mapping[str, float], intercept: float = 0.0) -> Column:
    """``b0 + sum_j b_j * x_j`` as one literal expression (scored on executors)."""
    expr = F.lit(float(intercept))
    for name, b in coefs.items():
        expr = expr + F.lit(float(b)) * F.col(name)
    return expr


def safe_ratio(num, den) -> Column:
    """num/den as double, NULL when the denominator is 0 (undefined metric)."""
    num, den = _c(num), _c(den)
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def snake_case(name: str) -> str:
    """Column-name sanitiser used at the scan (S3).

    Where R's ``data.frame()`` turns spaces and symbols into dots, we turn any
    run of non-alphanumerics into one underscore and lower-case the rest,
    because dotted names break Spark's formula and column resolution.
    """
    s = re.sub(r"[^0-9A-Za-z]+", "_", name.strip()).strip("_").lower()
    if not s:
        s = "col"
    if s[0].isdigit():
        s = "x" + s
    return s
