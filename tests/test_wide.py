"""Factors of many levels against dense dummies and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import glm, wide


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(21)
    n = 900
    level = np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 12, n))  # a third in one level
    x, u = rng.normal(size=n) + 50, rng.normal(size=n)
    eta = 0.4 * (level % 4) - 0.8 + 0.7 * (x - 50) - 0.3 * u
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(float)
    z = eta + rng.normal(size=n)
    data = [(int(a), *map(float, r)) for a, *r in zip(level, x, u, 2 * u + 1, y, z)]
    return spark.createDataFrame(data, "g long, x double, u double, dup double, y double, z double").withColumns(
        {f"g{k}": (F.col("g") == k).cast("double") for k in range(1, 12)})


@pytest.mark.parametrize("family,label", [("binomial", "y"), ("gaussian", "z")])
def test_equals_dense_dummies(rows, family, label):
    dense = glm.fit(rows, [*[f"g{k}" for k in range(1, 12)], "x", "u"], label, family)
    got = wide.fit_wide(rows, "g", ["x", "u", "dup"], label, family)
    assert got.converged and got.rank == dense.rank == 14 and got.n_levels == 12 and got.separated == 0
    assert got.deviance == pytest.approx(dense.deviance, rel=1e-9) and got.aic() == pytest.approx(dense.aic(), rel=1e-9)
    se = np.sqrt(np.diag(dense.cov()))
    for (name, b, s), i in zip(got.columns, (12, 13)):
        assert (b, s) == (pytest.approx(dense.beta[i], rel=1e-6), pytest.approx(se[i], rel=1e-6)), name
    assert np.isnan(got.columns[2][1])
    levels = {r.level: r for r in got.levels.collect()}
    assert levels[0].estimate == pytest.approx(dense.beta[0], rel=1e-6) and levels[0].std_error == pytest.approx(se[0], rel=1e-5)
    for k in range(1, 12):
        assert levels[k].estimate == pytest.approx(dense.beta[0] + dense.beta[k], rel=1e-6)
    assert levels[0].n == 300


def test_twenty_thousand_levels(spark):
    df = (spark.range(100_000).withColumn("g", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 20_000))
          .withColumns({"x": F.pmod(F.xxhash64("id"), F.lit(1000)) / 100.0})
          .withColumn("z", F.col("g") % 7 + 2.5 * F.col("x") + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 50.0))
    got = wide.fit_wide(df, "g", ["x"], "z", "gaussian")
    pdf = df.toPandas()
    centred = pdf[["x", "z"]] - pdf.groupby("g")[["x", "z"]].transform("mean")
    slope = (centred.x * centred.z).sum() / (centred.x ** 2).sum()
    assert got.n_levels == pdf.g.nunique() > 20_000 - 1 and got.columns[0][1] == pytest.approx(slope, rel=1e-9)
    assert got.deviance == pytest.approx(((centred.z - slope * centred.x) ** 2).sum(), rel=1e-8)
    means = pdf.groupby("g")[["x", "z"]].mean()
    want = means.z - slope * means.x
    own = got.levels.toPandas().set_index("level").estimate
    assert np.allclose(own.sort_index(), want.sort_index(), rtol=1e-8)


def test_separated_levels_and_nothing(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 0.0), (3, 1.0), (3, 0.0), (3, 0.0), (None, 1.0), (4, None)], "g long, y double")
    got = wide.fit_wide(df, "g", [], "y")
    assert (got.n, got.n_levels, got.separated, got.converged) == (6, 3, 2, True)
    assert {r.level: r.estimate for r in got.levels.collect()} == {1: None, 2: None, 3: pytest.approx(np.log(0.5))}
    none = wide.fit_wide(df.limit(0), "g", [], "y")
    assert none.n_levels == 0 and none.levels.collect() == [] and none.deviance == 0
    cut = wide.fit_wide(df.withColumn("x", F.col("y") * 0.1 + F.col("g")), "g", ["x"], "y", max_iter=2)
    assert not cut.converged
