"""Batched fits: parity with closed forms, Spark ML and numpy; selection invariants."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from cohortlens.operators import glm
from cohortlens.operators import linear as ln
from cohortlens.operators.selection import Search, stepwise_many


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(21)
    n = 1500
    x1, x2, x3 = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    eta = -0.3 + 0.8 * x1 - 0.5 * x2
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-eta))).astype(float)
    z = 2 + 1.5 * x1 - x3 + rng.normal(size=n)
    fold = np.arange(n) % 5
    rows = [(float(a), float(b), float(c), float(d), float(e), int(f), 1.0)
            for a, b, c, d, e, f in zip(x1, x2, x3, y, z, fold)]
    return spark.createDataFrame(rows, "x1 double, x2 double, x3 double, y double, z double, fold int, one double")


def test_batched_irls_matches_spark_glr(data):
    f = glm.fit(data, ["x1", "x2", "x3"], "y")
    va = VectorAssembler(inputCols=["x1", "x2", "x3"], outputCol="features")
    m = GeneralizedLinearRegression(family="binomial", link="logit", regParam=0.0, labelCol="y",
                                    tol=1e-12, maxIter=100).fit(va.transform(data))
    assert f.beta[0] == pytest.approx(m.intercept, abs=1e-6)
    assert np.allclose(f.beta[1:], m.coefficients.toArray(), atol=1e-6)
    assert f.aic() == pytest.approx(m.summary.aic, abs=1e-6)


def test_aliased_column_dropped(data):
    f = glm.fit(data, ["x1", "one", "x2"], "y")
    assert f.aliased == ["one"] and f.rank == 3
    g = glm.fit(data, ["x1", "x2"], "y")
    assert f.aic() == pytest.approx(g.aic(), abs=1e-8)


def test_fold_exclusion_equals_filter(data):
    a = glm.fit_many(data, {"m": glm.Spec(("x1",), exclude_fold=2)}, "y", fold_col="fold")["m"]
    b = glm.fit(data.where("fold != 2"), ["x1"], "y")
    assert np.allclose(a.beta, b.beta, atol=1e-10)


def test_gaussian_and_gram_match_numpy(data):
    pdf = data.toPandas()
    X = np.column_stack([np.ones(len(pdf)), pdf[["x1", "x3"]].to_numpy()])
    beta, *_ = np.linalg.lstsq(X, pdf["z"].to_numpy(), rcond=None)
    f = glm.fit(data, ["x1", "x3"], "z", "gaussian")
    g = ln.gram(data, ["x1", "x2", "x3"], "z", "fold")
    h = g.solve(["x1", "x3"])
    assert np.allclose(f.beta, beta) and np.allclose(h.beta, beta)
    # CV MSE from fold Grams equals explicit refits
    errs = []
    for k in range(5):
        tr, te = pdf[pdf.fold != k], pdf[pdf.fold == k]
        Xt = np.column_stack([np.ones(len(tr)), tr[["x1", "x3"]].to_numpy()])
        b, *_ = np.linalg.lstsq(Xt, tr["z"].to_numpy(), rcond=None)
        Xe = np.column_stack([np.ones(len(te)), te[["x1", "x3"]].to_numpy()])
        errs.append(np.mean((te["z"].to_numpy() - Xe @ b) ** 2))
    assert g.cv_mse(["x1", "x3"]) == pytest.approx(np.mean(errs), rel=1e-9)


def test_stepwise_aic_non_increasing_and_drops_noise(data):
    terms = {"x1": ["x1"], "x2": ["x2"], "x3": ["x3"]}
    res = stepwise_many(data, {"a": Search(terms, ["x1", "x2", "x3"])}, "y")["a"]
    aics = [a for _, _, a in res.path]
    assert all(b <= a + 1e-9 for a, b in zip(aics, aics[1:]))
    assert set(res.current) == {"x1", "x2"}


def test_linear_stepwise_gram(data):
    g = ln.gram(data, ["x1", "x2", "x3"], "z")
    chosen, f, path = ln.stepwise_gram(g, {"x1": ["x1"], "x2": ["x2"], "x3": ["x3"]}, ["x1", "x2", "x3"])
    assert set(chosen) == {"x1", "x3"}


def test_sqhinge_separates(data):
    f = glm.fit_many(data, {"s": glm.Spec(("x1", "x2"), cost=1.0)}, "y", "sqhinge")["s"]
    assert f.converged and f.beta[1] > 0 > f.beta[2]


def test_t_tail():
    assert glm._t_sf2(2.0, 10) == pytest.approx(0.07338803477, abs=1e-9)
    assert glm.norm_sf2(1.959963985) == pytest.approx(0.05, abs=1e-9)


def test_gram_many_matches_single(data):
    d = data.withColumn("a", (F.col("fold") < 3).cast("int")).withColumn("b", F.lit(1))
    many = ln.gram_many(d, ["x1", "x3"], "z", {"a": ("a", "fold"), "b": ("b", None)})
    one_a = ln.gram(d.where("a = 1"), ["x1", "x3"], "z", "fold")
    one_b = ln.gram(d, ["x1", "x3"], "z")
    for m, one in ((many["a"], one_a), (many["b"], one_b)):  # factors are unique up to signs of their rows
        assert np.allclose(m.total.T @ m.total, one.total.T @ one.total)
    assert many["a"].cv_mse(["x1"]) == pytest.approx(one_a.cv_mse(["x1"]), rel=1e-12)


def test_evaluate_logistic_matches_explicit_refits(spark, data):
    from cohortlens.operators import metrics as mt
    from cohortlens.plans.chronological import Evaluated, Scenario, build_design, evaluate_logistic
    d = (data.withColumn("id", F.monotonically_increasing_id()).withColumn("f", F.lit("a"))
         .withColumn("tr", (F.rand(seed=3) < 0.7).cast("int")))
    d = d.withColumn("te", 1 - F.col("tr")).drop("fold")
    s = Scenario("s", "tr", "te")
    des = build_design(d, ["f"], ["x1", "x2"], "y", [s], k=5)
    f = glm.fit_many(des.df, {"m": glm.Spec(("x1", "x2"), include="tr")}, "y")["m"]
    res = evaluate_logistic(des, [Evaluated(s, 1, f)], k=5)[0].first()
    pdf = des.df.select("x1", "x2", "y", "tr", "te", "fold_s").toPandas()
    wrong = 0
    for j in range(5):
        tr = des.df.where(f"tr = 1 AND fold_s != {j}")
        fj = glm.fit(tr, ["x1", "x2"], "y")
        part = pdf[(pdf.tr == 1) & (pdf.fold_s == j)]
        p = 1 / (1 + np.exp(-(fj.beta[0] + fj.beta[1] * part.x1 + fj.beta[2] * part.x2)))
        wrong += int((np.abs(part.y - p) > 0.5).sum())
    assert res["cv_error"] == pytest.approx(wrong / int((pdf.tr == 1).sum()), abs=1e-12)
    te = pdf[pdf.te == 1]
    p = 1 / (1 + np.exp(-(f.beta[0] + f.beta[1] * te.x1 + f.beta[2] * te.x2)))
    assert res["tp"] == int(((p > 0.5) & (te.y == 1)).sum()) and res["tn"] == int(((p <= 0.5) & (te.y == 0)).sum())
    want_auc = mt.auc(spark.createDataFrame([(int(a), float(b)) for a, b in zip(te.y, p)], "final int, score double")).first()["auc"]
    assert res["auc"] == pytest.approx(want_auc, abs=1e-9)


def _hat(X, w):
    Xw = X * np.sqrt(w)[:, None]
    return np.einsum("ij,ij->i", Xw @ np.linalg.inv(Xw.T @ Xw), Xw)


def test_logistic_leverage_and_cooks_match_numpy(data):
    from cohortlens.operators import diagnostics as dg
    f = glm.fit(data, ["x1", "x2"], "y")
    got = dg.with_influence(data, f, "y").select("x1", "x2", "y", "h", "cooks_d").toPandas()
    X = np.column_stack([np.ones(len(got)), got.x1, got.x2])
    mu = 1 / (1 + np.exp(-(X @ f.beta)))
    h = _hat(X, mu * (1 - mu))
    r = (got.y - mu) / np.sqrt(mu * (1 - mu))
    cook = (r / (1 - h)) ** 2 * h / 3
    assert np.allclose(got.h, h, atol=1e-9) and np.allclose(got.cooks_d, cook, atol=1e-9)


def test_linear_influence_and_studentised_match_numpy(data):
    from cohortlens.operators import diagnostics as dg
    f = glm.fit(data, ["x1", "x3"], "z", "gaussian")
    got = dg.with_influence(data, f, "z").select("x1", "x3", "z", "h", "cooks_d").toPandas()
    X = np.column_stack([np.ones(len(got)), got.x1, got.x3])
    e = got.z - X @ f.beta
    h = _hat(X, np.ones(len(got)))
    n, p = X.shape
    s2 = (e ** 2).sum() / (n - p)
    assert np.allclose(got.h, h, atol=1e-9)
    assert np.allclose(got.cooks_d, e ** 2 * h / (s2 * p * (1 - h) ** 2), atol=1e-9)
    top = dg.outlier_test(data.withColumn("id", F.monotonically_increasing_id()), f, "z").toPandas()
    s_i = np.sqrt(((e ** 2).sum() - e ** 2 / (1 - h)) / (n - p - 1))
    rst = e / (s_i * np.sqrt(1 - h))
    assert np.allclose(np.sort(np.abs(top.rstudent))[::-1], np.sort(np.abs(rst))[::-1][:10], atol=1e-9)


def test_odds_ratio_beyond_the_doubles(spark):
    """a negative slope on a column of mean 1e6 has an intercept whose exp is no double."""
    rows = [(1e6 + x, y) for x, y, n in [(0, 1.0, 60), (0, 0.0, 40), (1, 1.0, 40), (1, 0.0, 60)] for _ in range(n)]
    f = glm.fit(spark.createDataFrame(rows, "far double, y double"), ["far"], "y")
    intercept, slope = glm.coefficient_rows(f)
    assert intercept[2] > 800 and intercept[-1] == math.inf
    assert slope[2] == pytest.approx(2 * math.log(2 / 3), abs=1e-6) and slope[-1] == pytest.approx(4 / 9, abs=1e-6)


def test_hinge_sums_are_each_models_own_with_few_rows_multiplied(monkeypatch):
    """Models of one design share cross products; the sums stay those of each one's active rows."""
    rng = np.random.default_rng(3)
    n, p = 4000, 6
    X = np.column_stack([np.ones(n), rng.normal(size=(n, p - 1))])
    y = (X @ rng.normal(size=p) + rng.normal(size=n) > 0).astype(float)
    w, t = rng.uniform(0.5, 2.0, n), 2 * y - 1
    fold = np.where(np.arange(n) % 50 == 0, np.nan, np.arange(n) % 10)  # some rows have no fold
    base = rng.normal(size=p)
    models = [(c, j, base + 1e-3 * rng.normal(size=p)) for c in (1.0, 10.0, 100.0) for j in range(10)]
    models += [(1.0, 3, None), (5.0, None, -base), (1.0, 77, None)]
    rows, cross = [], glm._cross
    monkeypatch.setattr(glm, "_cross", lambda X, w: rows.append(len(w)) or cross(X, w))
    got = glm._hinge_sums(X, t, w, fold, models)
    alone = 0
    for (_, j, beta), v in zip(models, got):
        kept = fold != (np.nan if j is None else j)
        margin = 1 - t * (X @ (np.zeros(p) if beta is None else beta))
        on = kept & (margin > 0)
        alone += on.sum()
        G, b = X[on].T @ (w[on, None] * X[on]), (w * t)[on] @ X[on]
        want = [*G[np.triu_indices(p)], *b, (w[on] * margin[on] ** 2).sum(), w[kept].sum()]
        assert np.allclose(v, want, rtol=1e-10, atol=1e-8)
    assert sum(rows) < alone / 5


def test_hinge_sums_without_kept_rows():
    X, one = np.ones((5, 1)), np.ones(5)
    got = glm._hinge_sums(X, one, one, np.zeros(5), [(1.0, 0, None), (1.0, 0, np.zeros(1)), (1.0, 1, np.zeros(1))])
    assert got[0] is None and got[1] is None and np.allclose(got[2], [5, 5, 5, 5])


@pytest.mark.parametrize("columns, many", [(9, 60), (9, 2)])
def test_binomial_sums_are_each_models_own(columns, many):
    """Models of one row set share matrix products; the sums stay those of each model alone."""
    rng = np.random.default_rng(4)
    n = 2 * glm.BLOCK + 17
    X = np.column_stack([np.ones(n), rng.normal(size=(n, columns - 1))])
    w, fold = rng.uniform(0.5, 2.0, n), np.where(np.arange(n) % 50 == 0, np.nan, np.arange(n) % 5)
    for y in ((rng.uniform(size=n) < 0.4).astype(float), rng.uniform(size=n)):
        models = []
        for i in range(many):
            cols = sorted({0, *rng.choice(columns, size=rng.integers(1, columns), replace=False).tolist()})
            models.append((cols, [None, 0, 3][i % 3], None if i % 7 == 0 else 20 * rng.normal(size=len(cols)) * (i % 2) + rng.normal(size=len(cols))))
        for (cols, j, beta), v in zip(models, glm._binomial_sums(X, y, w, fold, models)):
            kept = fold != (np.nan if j is None else j)
            want = glm._partials(X[np.ix_(kept, cols)], y[kept], w[kept], beta)
            assert np.allclose(v, want, rtol=1e-9, atol=1e-6)


def test_equal_models_are_fitted_once(data, monkeypatch):
    """pairs of scenarios that train on the same rows have the same models."""
    passes, run = [], glm._pass
    monkeypatch.setattr(glm, "_pass", lambda data, specs, *a: passes.append(len(specs)) or run(data, specs, *a))
    specs = {"a": glm.Spec(("x1", "x2")), "b": glm.Spec(("x1", "x2")), "c": glm.Spec(("x1",)),
             "d": glm.Spec(("x1", "x2"), beta0=np.zeros(3))}
    fits = glm.fit_many(data, specs, "y")
    assert max(passes) == 3 and set(fits) == set(specs) and np.array_equal(fits["a"].beta, fits["b"].beta)
    assert fits["a"].extra is not fits["b"].extra and np.allclose(fits["a"].beta, fits["d"].beta)


def test_unknown_values_touch_their_own_models_only(data):
    d = data.withColumn("gap", F.when(F.col("x3") > 0, F.col("x3")))
    fits = glm._pass(glm.Input(d, {"m": glm.Spec(("x1", "gap"))}, "y"), {"m": glm.Spec(("x1",)), "g": glm.Spec(("gap",))},
                     {"m": None, "g": None}, "binomial", np.zeros(2), np.ones(2))
    assert np.isfinite(fits["m"][0]).all() and np.isnan(fits["g"][0]).any()


def test_solve_where_all_weights_vanish():
    assert np.allclose(glm._solve(np.ones((2, 2)), np.ones(2), [0, 1]), 0.5)
