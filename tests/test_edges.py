"""Edge rows of the core operators: text weeks, clashing levels, undefined ratios, unfinished fits."""

import math

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import diagnostics, features, glm, metrics, prepare, profile, ranking, sampling


def test_zero_fill_of_text_weeks(spark):
    df = spark.createDataFrame([(1, None, 60.0), (2, "7.5", 40.0), (3, "bad", 50.0)], "id bigint, w1 string, final double")
    out = {r.id: r.w1 for r in prepare.prepare_student(df, ["w1"], [], [], "final", 50.0).collect()}
    assert out == {1: 0.0, 2: 7.5}  # absent is 0; text that is no number is dropped


def test_levels_that_clash_in_name_keep_their_columns(spark):
    df = spark.createDataFrame([("base",), ("N/A",), ("N A",), ("n-a",), (None,)], "f string").withColumn("F_n_a", F.lit(1))
    enc = features.fit_encoding(df, ["f"], {"f": "base"})
    assert len({c.lower() for c in enc.columns["f"]} | {"f_n_a"}) == 4
    out = features.one_hot(df, enc, keep_factors=True).collect()
    for r in out:
        hot = [c for c in enc.columns["f"] if r[c] == 1.0]
        assert len(hot) == (0 if r.f in ("base", None) else 1) and all((r[c] is None) == (r.f is None) for c in enc.columns["f"])


def test_more_than_a_thousand_levels(spark):
    df = spark.range(1500).select(F.col("id").cast("string").alias("f"))
    assert len(features.factor_levels(df, ["f"])["f"]) == 1500


def test_constant_column_has_no_scale(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "c double, x double")
    rows = features.standardise(df, ["c", "x"]).collect()
    assert [r.c for r in rows] == [None, None] and rows[0].x == pytest.approx(-rows[1].x)


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.7)], "final int, score double")
    assert metrics.auc(df).first().auc is None
    both = spark.createDataFrame([("a", 1, 0.2), ("a", 1, 0.7), ("b", 0, 0.1), ("b", 1, 0.9)], "g string, final int, score double")
    assert {r.g: r.auc for r in metrics.auc(both, group_cols=["g"]).collect()} == {"a": None, "b": 1.0}


def test_undefined_influence_and_density_are_null(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0), (0.0, 4.0), (1.0, 9.0)], "x double, y double")
    fit = glm.fit(df, ["x"], "y", "gaussian")  # the last row alone holds its level: leverage 1
    rows = diagnostics.with_influence(df, fit, "y").collect()
    assert all(r.cooks_d is None or math.isfinite(r.cooks_d) for r in rows) and rows[0].cooks_d is not None
    from cohortlens.functions.columns import dnorm
    assert df.select(dnorm("x", 0.0, 0.0).alias("d")).first().d is None


def test_separated_and_unfinished_fits_say_so(spark):
    df = spark.createDataFrame([(float(i), int(i >= 10)) for i in range(20)], "x double, y int")
    fit = glm.fit(df, ["x"], "y", max_iter=60)
    table = glm.coefficient_table(spark, fit).collect()
    assert fit.separated and all(r.std_error is None and r.p_value is None for r in table)
    noisy = spark.createDataFrame([(float(i), int((i * 7) % 5 > 1)) for i in range(40)], "x double, y int")
    short = glm.fit(noisy, ["x"], "y", max_iter=2)
    assert not short.converged and short.n == 40 and math.isfinite(short.deviance)
    assert all(r.std_error is None for r in glm.coefficient_table(spark, short).collect())


def test_quantiles_skip_nan(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),), (None,)], "x double")
    assert ranking.quantiles_type7(df, "x", [0.0, 0.5, 1.0]) == [1.0, 2.0, 3.0]
    r = profile.numeric_summary(df, ["x"]).first()
    assert (r["min"], r.median, r["max"], r.n_null) == (1.0, 2.0, 3.0, 1)


def test_smaller_class_is_found(spark):
    df = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(100)], "id bigint, final int")
    out = sampling.downsample_majority(df, minority=None).groupBy("final").count().collect()
    assert {r.final: r["count"] for r in out} == {0: 20, 1: 20}
