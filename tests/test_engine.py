"""Factors, batched fits and scores, SVM calibration and convergence flags."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import diagnostics as dg
from cohortlens.operators import factor as fc
from cohortlens.operators import glm
from cohortlens.operators import linear as ln
from cohortlens.operators import selection as sl
from cohortlens.operators import svm as sv
from cohortlens.plans import chronological as ch


def frame(spark, columns):
    names = list(columns)
    return spark.createDataFrame([tuple(float(columns[c][i]) for c in names) for i in range(len(columns[names[0]]))], ", ".join(f"{c} double" for c in names))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    n = 600
    x = {f"x{i}": rng.normal(size=n) for i in range(4)}
    x["far"] = 1e6 + rng.normal(size=n)
    x["dup"] = x["x0"] - 2 * x["x1"]
    x["flat"] = np.full(n, 3.0)
    x["y"] = (rng.random(n) < 1 / (1 + np.exp(-(x["x0"] - 0.5 * x["x1"] + (x["far"] - 1e6))))).astype(float)
    x["z"] = 2 + x["x0"] + 3 * (x["far"] - 1e6) + rng.normal(size=n)
    x["fold"] = np.arange(n) % 5
    x["tr"] = (np.arange(n) % 4 > 0).astype(float)
    return x


def test_factor_of_row_sets(spark, rows):
    df = frame(spark, rows).repartition(7)
    got = fc.factors(df, ["x0", "far"], {"all": (None, None), "part": ("tr", "fold")})
    Z = np.column_stack([np.ones(600), rows["x0"], rows["far"]])
    assert np.allclose(got["all"][0].T @ got["all"][0], Z.T @ Z, rtol=1e-12)
    assert sorted(got["part"]) == [0, 1, 2, 3, 4]
    for k, R in got["part"].items():
        own = Z[(rows["tr"] == 1) & (rows["fold"] == k)]
        assert np.allclose(R.T @ R, own.T @ own, rtol=1e-12)
    assert fc.factors(df.limit(0), ["x0"], {"all": (None, None)}) == {"all": {}}


def test_far_column_is_kept_and_dependent_ones_are_not(spark, rows):
    df = frame(spark, rows)
    for family, y in (("binomial", "y"), ("gaussian", "z")):
        f = glm.fit(df, ["x0", "x1", "far", "dup", "flat"], y, family)
        assert f.aliased == ["dup", "flat"] and f.rank == 4 and f.converged
        near = glm.fit(df.withColumn("near", F.col("far") - 1e6), ["x0", "x1", "near"], y, family)
        assert f.beta[3] == pytest.approx(near.beta[3], rel=1e-7) and f.deviance == pytest.approx(near.deviance, rel=1e-9)
        assert np.sqrt(f.cov()[3, 3]) == pytest.approx(np.sqrt(near.cov()[3, 3]), rel=1e-6)
        h = dg.with_influence(df, f, y).agg(F.sum("h"), F.max("h")).first()
        assert h[0] == pytest.approx(4, rel=1e-6) and 0 < h[1] < 1
    g = ln.gram(df, ["x0", "far", "dup", "x1"], "z", "fold")
    assert g.solve(["far"]).beta[1] == pytest.approx(np.polyfit(rows["far"] - 1e6, rows["z"], 1)[0], rel=1e-8)
    assert g.solve(["x0", "x1", "dup"]).aliased == ["dup"]


def test_searches_over_few_rows_or_none(spark, rows):
    df = frame(spark, rows).withColumns({"none": F.lit(0), "one": (F.col("x0") == float(rows["x0"][3])).cast("int")})
    grams = ln.gram_many(df, ["x0", "x1"], "z", {"none": ("none", "fold"), "one": ("one", "fold")})
    terms = {"x0": ["x0"], "x1": ["x1"]}
    for g in grams.values():
        chosen, f, path = ln.stepwise_gram(g, terms, ["x0", "x1"])
        assert f.extra["finished"] and np.isnan(f.extra["adj_r2"])
    assert np.isnan(grams["none"].cv_mse(["x0"])) and grams["none"].solve(["x0"]).aic() == np.inf
    assert glm.fit_many(df, {"m": glm.Spec(("x0",), include="none")}, "y")["m"].aic() == np.inf


def test_influence_of_52_coefficients(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(400, 51)) + np.arange(51)
    cols = {f"c{i}": X[:, i] for i in range(51)}
    cols["y"] = X[:, :5].sum(1) + rng.normal(size=400)
    df = frame(spark, cols)
    f = glm.fit(df, [f"c{i}" for i in range(51)], "y", "gaussian")
    got = dg.with_influence(df, f, "y").select("y", "h", "cooks_d").toPandas().sort_values("y")
    A = np.column_stack([np.ones(400), X])
    h = np.einsum("ij,ij->i", A @ np.linalg.inv(A.T @ A), A)
    e = cols["y"] - A @ np.linalg.lstsq(A, cols["y"], rcond=None)[0]
    cook = e ** 2 * h / ((e @ e) / (400 - 52) * 52 * (1 - h) ** 2)
    order = np.argsort(cols["y"])
    assert np.allclose(got.h, h[order], atol=1e-9) and np.allclose(got.cooks_d, cook[order], atol=1e-9)


def test_one_input_serves_a_search(spark, rows, monkeypatch):
    df = frame(spark, rows)
    cached, passes = [], []
    monkeypatch.setattr(glm, "_sized_cache", lambda d, real=glm._sized_cache: cached.append(1) or real(d))
    monkeypatch.setattr(glm, "factors", lambda *a, real=glm.factors: passes.append(1) or real(*a))
    terms = {c: [c] for c in ("x0", "x1", "x2", "x3")}
    s = sl.stepwise_many(df, {"a": sl.Search(terms, list(terms)), "b": sl.Search(terms, ["x2", "x3"], include="tr")}, "y")
    assert s["a"].done and s["b"].done and {"x0", "x1"} <= set(s["a"].current)
    assert len(cached) == 1 and len(passes) == 1


def test_cut_searches_and_fits_say_so(spark, rows):
    df = frame(spark, rows)
    terms = {c: [c] for c in ("x2", "x3", "flat", "x0")}
    cut = sl.stepwise_many(df, {"a": sl.Search(terms, list(terms))}, "y", max_rounds=1)["a"]
    assert not cut.done and len(cut.path) == 2
    assert not glm.fit(df, ["x0", "x1"], "y", max_iter=2).converged
    assert all(r[3] is None for r in glm.coefficient_rows(glm.fit(df, ["x0"], "y", max_iter=2)))
    d = df.withColumns({"id": F.monotonically_increasing_id(), "tr": F.col("tr").cast("int"), "te": (1 - F.col("tr")).cast("int"), "y": F.col("y").cast("int")}).drop("fold")
    des = ch.build_design(d, [], ["x0", "x2", "x3"], "y", [ch.Scenario("s", "tr", "te")], k=5)
    done = ch.chronological_logistic(des, [["x0", "x2", "x3"]], k=5)[0].first()
    half = ch.chronological_logistic(des, [["x0", "x2", "x3"]], k=5, max_rounds=1)[0].first()
    assert done["finished"] and done["converged"] and not half["finished"]


def test_score_rows_and_sums_judge_each_row_by_its_own_models(spark, rows):
    df = frame(spark, rows)
    specs = {f"m{j}": glm.Spec(("x0", "x1"), include="tr", fold_col="fold", exclude_fold=j) for j in range(5)}
    fits = glm.fit_many(df, specs, "y")
    model = glm.Judged(specs["m0"], rows="tr", folds={j: fits[f"m{j}"] for j in range(5)}, fold_col="fold", response=True)
    whole = glm.Judged(specs["m0"], fits["m0"], shift=0.25)
    got = glm.score_long(df, [model, whole], "y").toPandas()
    A = np.column_stack([np.ones(600), rows["x0"], rows["x1"]])
    own = np.array([A[i] @ fits[f"m{int(rows['fold'][i])}"].beta for i in range(600)])
    want = (1 / (1 + np.exp(-own)))[rows["tr"] == 1]
    assert np.allclose(np.sort(got[got.model == 0].score), np.sort(want))
    assert np.allclose(np.sort(got[got.model == 1].score), np.sort(A @ fits["m0"].beta - 0.25))
    sums = glm.model_sums(df.repartition(5), [model, whole], "y", 2, lambda i, y, s: [len(y), s.sum()])
    assert sums[:, 0].tolist() == [450, 600] and sums[0, 1] == pytest.approx(want.sum())


@pytest.fixture(scope="module")
def ring(spark):
    """Class 1 lies in a ring: no line separates it, a radial kernel does."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 2))
    r = np.hypot(*x.T)
    y = ((r > 0.7) & (r < 1.6)) ^ (rng.random(700) < 0.05)
    return spark.createDataFrame([(i, *map(float, x[i]), int(y[i]), int(i % 4 > 0), int(i % 4 == 0), int(i % 5)) for i in range(700)],
                                 "id long, a double, b double, y int, tr int, te int, fold int").cache()


def test_svm_finds_a_radial_signal(ring):
    from cohortlens.operators import metrics as mt
    spec = sv.svm_spec(["a", "b"], 1.0, 10.0, include="tr")
    fit = sv.fit_svms(ring, {"m": spec}, "y")
    held = sv.with_decisions(ring, {"m": spec}, fit, {"m": "dec"}).where("te = 1")
    assert mt.auc(held, "y", "dec").first()["auc"] > 0.8
    line = glm.fit(ring.where("tr = 1"), ["a", "b"], "y")
    assert mt.auc(ring.where("te = 1").withColumn("p", line.response()), "y", "p").first()["auc"] < 0.7


def test_out_of_fold_calibration_is_less_sure(ring):
    spec = {"m": sv.svm_spec(["a", "b"], 20.0, 1000.0, include="tr")}
    fit = sv.fit_svms(ring, spec, "y")
    within = sv.platt_scales(ring, [glm.Judged(spec["m"], fit["m"], "tr")], "y")[0]
    crossed = sv.cross_fitted_platt(ring, spec, "y", {"m": "fold"}, k=5, start=fit)["m"]
    assert within.converged and crossed.converged and 0 < crossed.slope < within.slope
    d = sv.with_decisions(ring, spec, fit, {"m": "dec"}).where("te = 1")
    loss = {n: d.agg(F.avg(-F.log(F.when(F.col("y") == 1, p.probability(F.col("dec"))).otherwise(1 - p.probability(F.col("dec")))))).first()[0]
            for n, p in (("within", within), ("crossed", crossed))}
    assert loss["crossed"] < loss["within"]


def test_platt_scale_is_a_logistic_fit_of_the_decision(ring):
    spec = {"m": sv.svm_spec(["a", "b"], 1.0, 1.0, include="tr")}
    fit = sv.fit_svms(ring, spec, "y")
    got = sv.platt_scales(ring, [glm.Judged(spec["m"], fit["m"], "tr")], "y")[0]
    want = glm.fit(sv.with_decisions(ring, spec, fit, {"m": "dec"}).where("tr = 1"), ["dec"], "y")
    assert [got.intercept, got.slope] == pytest.approx(list(want.beta), rel=1e-4)


def test_variants_flag_rows_of_one_table(spark):
    from cohortlens.operators.prepare import prepare_student
    from cohortlens.plans.scenarios import VARIANTS, preparation_variants, variant_scenarios
    rows_ = [(i, 2015 + i % 3, "s" if i % 11 else None, float(i) if i % 13 else None, [5.0, None, 1.0][i % 3], None if i % 4 else 2.0, None if i % 17 == 0 else float(40 + i % 20))
             for i in range(200)]
    wide = spark.createDataFrame(rows_, "id long, year long, segment string, acctbal double, w1 double, w2 double, final double")
    got, scenarios = variant_scenarios(preparation_variants(wide, ["w1", "w2"], ["acctbal"], ["segment"], "final", ["w2"]))
    assert len(scenarios) == 6 * len(VARIANTS)
    for bit, (name, mark, variant, sparse) in enumerate([("mark50", 50, "fill", []), ("mark55", 55, "fill", []), ("filledthendropped", 50, "fill_then_drop", ["w2"]),
                                                         ("dropped", 50, "drop_only", ["w2"])]):
        want = prepare_student(wide, ["w1", "w2"] if not sparse else ["w1"], ["acctbal"], ["segment"], "final", float(mark), variant=variant) if not sparse else \
            prepare_student(wide.drop("w2"), ["w1"], ["acctbal"], ["segment"], "final", float(mark), variant="fill" if variant == "fill_then_drop" else "drop_only")
        own = got.where(f"shiftright(variants, {bit}) % 2 = 1")
        assert {(r.id, r.final, r.w1) for r in want.collect()} == {(r.id, r[VARIANTS[name]], r.w1) for r in own.collect()}
        assert sum(got.agg(*[F.sum(f"{name}__y{y}") for y in (2015, 2016, 2017)]).first()) == want.count()


def test_cohorts_read_one_folder(spark, tmp_path):
    from cohortlens.sources.readers import read_cohorts
    from cohortlens.sources.sinks import write_cohorts
    df = spark.range(300).withColumns({"year": F.lit(2015) + F.col("id") % 3, "v": F.col("id") * 0.5})
    write_cohorts(df, str(tmp_path / "c"))
    back = read_cohorts(spark, str(tmp_path / "c"), df.schema)
    assert back.dtypes == df.dtypes and sorted(back.collect()) == sorted(df.collect())
    one = back.where("year = 2016")
    assert len(one.inputFiles()) >= 1 and "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().executedPlan().toString()
    assert one.select(F.input_file_name().alias("f")).where("f not like '%year=2016%'").count() == 0 and one.count() == 100


def test_listing_spreads_a_hot_group(spark):
    from cohortlens.operators.events import group_listing
    df = spark.range(1000).withColumn("user_id", F.when(F.col("id") % 3 > 0, 1).when(F.col("id") % 5 > 0, F.col("id") % 50)).withColumnRenamed("id", "event_id")
    got = group_listing(df, size=64).collect()
    assert max(len(r.rows) for r in got) <= 64 and sum(r.user_id == 1 for r in got) > 9
    lists = {}
    for r in sorted(got, key=lambda r: (r.user_id is not None, r.user_id or 0, r.chunk)):
        assert r.n == len(r.rows) and r.chunk == sum(x is not None for x in lists.get(r.user_id, []))
        lists.setdefault(r.user_id, []).append(list(r.rows))
    want = {}
    for r in df.orderBy("event_id").collect():
        want.setdefault(r.user_id, []).append(r.event_id)
    assert {k: sum(v, []) for k, v in lists.items()} == want
