"""Registered queries: model runs whose results have a closed form in SQL.

A logistic model of one factor has the group means as fitted probabilities, so
its AIC, its out-of-fold predictions (the means of the other folds) and its
holdout counts follow; a one-predictor OLS has ``regr_*``.  The same operators
run the chronological searches of ``catalog_models``, which have no SQL form.
The chronological factor run has four time points, one factor each, over two
(train, test) scenarios.  Thresholds lie a little off one half, so that a group
mean of exactly one half falls on one side on both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import diagnostics as dg
from cohortlens.operators import features as fe
from cohortlens.operators import glm
from cohortlens.operators import metrics as mt
from cohortlens.operators.selection import compare_models, univariable_screen
from cohortlens.plans import chronological as ch
from cohortlens.plans.catalog_eval import _METRICS_SQL
from cohortlens.plans.catalog_models import _OLS_SQL, _ols, _residuals
from cohortlens.plans.common import NUMERIC_PREPARED_SQL, PREPARED_SQL, cached, prepared
from cohortlens.plans.registry import register
from cohortlens.plans.scenarios import standard_scenarios
from cohortlens.sources.tables import load

MARK = 46.0  # passes are a clear majority at this mark
ABOVE_HALF = 0.5000001
TIME_POINTS = [["segment"], ["region"], ["band"], ["segment"]]
_BAND = "CASE WHEN acctbal < 2000 THEN 'low' WHEN acctbal < 6000 THEN 'mid' ELSE 'high' END"


def _cost(y, p):
    """A user's cost (F1): wrong by half or more."""
    return (F.abs(y - p) > F.lit(0.4999999)).cast("double")


def _banded(spark, sf_dir) -> DataFrame:
    return prepared(spark, sf_dir, MARK).withColumn("band", F.expr(_BAND))


def _factor_design(spark, sf_dir) -> ch.Design:
    def build():
        d, scenarios = standard_scenarios(_banded(spark, sf_dir), names=("full", "years"))
        return ch.build_design(d, ["segment", "region", "band"], [], "final", scenarios)
    return cached(spark, sf_dir, "design:factors", build)


def _factor_run(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Each scenario's factor models at each time point, evaluated with the user's cost."""
    def build():
        des = _factor_design(spark, sf_dir)
        cells = [(s, t, ch.expanded(des, terms)) for s in des.scenarios for t, terms in enumerate(TIME_POINTS, start=1)]
        fits = glm.fit_many(des.df, {f"{s.name}#{t}": glm.Spec(tuple(cols), include=s.train) for s, t, cols in cells}, "final")
        return ch.evaluate_logistic(des, [ch.Evaluated(s, t, fits[f"{s.name}#{t}"]) for s, t, _ in cells], pi=ABOVE_HALF, cost=_cost)
    return cached(spark, sf_dir, "factor_run", build)


_LOW_SQL = PREPARED_SQL.replace("final >= 50", "final >= 46")

_RUN_SQL = _LOW_SQL + f""",
base AS (SELECT id, year, final AS y, segment, region, {_BAND} AS band FROM prepared),
sp AS (SELECT *, row_number() OVER (ORDER BY md5(concat('46:', CAST(id AS VARCHAR)))) AS rk, count(*) OVER () AS n FROM base),
sc AS (SELECT 'full' AS scenario, id, y, segment, region, band, rk <= floor(0.8 * n) AS train, rk > floor(0.8 * n) AS test FROM sp
       UNION ALL SELECT 'years', id, y, segment, region, band, year IN (2015, 2016), year = 2017 FROM base),
fo AS (SELECT *, (row_number() OVER (PARTITION BY scenario, train ORDER BY md5(concat('1:', CAST(id AS VARCHAR)))) - 1) % 10 AS fold FROM sc),
lg AS (""" + " UNION ALL ".join(f"SELECT scenario, {t} AS time_point, id, y, train, test, fold, {terms[0]} AS lv FROM fo"
                                for t, terms in enumerate(TIME_POINTS, start=1)) + """),
gm AS (SELECT scenario, time_point, lv, count(*) AS n, sum(y) AS s, CAST(sum(y) AS DOUBLE) / count(*) AS p FROM lg WHERE train GROUP BY ALL),
gf AS (SELECT scenario, time_point, lv, fold, count(*) AS nf, sum(y) AS sf FROM lg WHERE train GROUP BY ALL),
cv AS (SELECT l.scenario, l.time_point,
         avg(CASE WHEN abs(l.y - CAST(gm.s - gf.sf AS DOUBLE) / (gm.n - gf.nf)) > 0.4999999 THEN 1.0 ELSE 0.0 END) AS cv_error
       FROM lg l JOIN gm ON l.scenario = gm.scenario AND l.time_point = gm.time_point AND l.lv = gm.lv
       JOIN gf ON l.scenario = gf.scenario AND l.time_point = gf.time_point AND l.lv = gf.lv AND l.fold = gf.fold
       WHERE l.train GROUP BY 1, 2),
ai AS (SELECT scenario, time_point, -2 * sum(s * ln(p) + (n - s) * ln(1 - p)) + 2 * count(*) AS aic FROM gm GROUP BY 1, 2),
cf AS (SELECT l.scenario, l.time_point,
         CAST(count_if(p <= 0.5000001 AND y = 0) AS BIGINT) AS tn, CAST(count_if(p <= 0.5000001 AND y = 1) AS BIGINT) AS fn,
         CAST(count_if(p > 0.5000001 AND y = 0) AS BIGINT) AS fp, CAST(count_if(p > 0.5000001 AND y = 1) AS BIGINT) AS tp
       FROM lg l JOIN gm ON l.scenario = gm.scenario AND l.time_point = gm.time_point AND l.lv = gm.lv WHERE l.test GROUP BY 1, 2),
run AS (SELECT cf.scenario, CAST(cf.time_point AS INTEGER) AS time_point, round(ai.aic, 6) AS aic, cv.cv_error, tn, fn, fp, tp, """ + _METRICS_SQL + """
        FROM cf JOIN cv ON cf.scenario = cv.scenario AND cf.time_point = cv.time_point
        JOIN ai ON cf.scenario = ai.scenario AND cf.time_point = ai.time_point)
"""


@register("factor_run_results", _RUN_SQL + "SELECT * FROM run")
def q_factor_run(spark, sf_dir):
    """G2 + G3 + G4 + G9 + F1: factor logits fitted on the training rows of two scenarios: AIC, 10-fold CV
    cost by a user function, holdout confusion and metrics, per time point."""
    res = _factor_run(spark, sf_dir)[0].drop("auc", "steps", "converged", "finished")
    return res.withColumn("aic", F.round("aic", 6))


_MEANS = ["accuracy", "specificity", "sensitivity", "npv", "fn", "fp", "cv_error"]
_SUMMARY_SQL = _RUN_SQL + ",\nsm AS (SELECT scenario, " + ", ".join(f"avg({m}) AS mean_{m}" for m in _MEANS) + " FROM run GROUP BY scenario)\n"


@register("factor_performance_summary", _SUMMARY_SQL + "SELECT * FROM sm")
def q_factor_summary(spark, sf_dir):
    """A16 + G25: means of the factor run's metrics over its time points."""
    return ch.performance_summary(_factor_run(spark, sf_dir)[0], _MEANS)


@register("factor_pair_means", _SUMMARY_SQL + "SELECT 'full_and_years' AS pair, " + ", ".join(
    f"avg(mean_{m}) AS mean_{m}" for m in _MEANS[:4]) + " FROM sm")
def q_factor_pairs(spark, sf_dir):
    """Mean of two runs' summaries."""
    perf = ch.performance_summary(_factor_run(spark, sf_dir)[0], _MEANS)
    return ch.pair_means(perf, {"full_and_years": ["full", "years"]}, [f"mean_{m}" for m in _MEANS[:4]])


@register("factor_accuracy_matrix", _RUN_SQL + "SELECT scenario, " + ", ".join(
    f'max(accuracy) FILTER (WHERE time_point = {t}) AS "{t}"' for t in range(1, 5)) + " FROM run GROUP BY scenario")
def q_factor_matrix(spark, sf_dir):
    """Accuracy as a scenario x time-point matrix."""
    return ch.metric_matrix(_factor_run(spark, sf_dir)[0], "accuracy")


@register("factor_false_rates", _RUN_SQL + """
SELECT scenario, time_point, fn AS false_fails, fp AS false_passes, CAST(fn AS DOUBLE) / CAST(tn + fn + fp + tp AS DOUBLE) AS false_fail_rate,
       CAST(fp AS DOUBLE) / CAST(tn + fn + fp + tp AS DOUBLE) AS false_pass_rate FROM run
""")
def q_factor_rates(spark, sf_dir):
    """A18 + A19: false fails and passes per time point, and their share of the actual test set."""
    return ch.per_time_point_rates(_factor_run(spark, sf_dir)[0])


@register("factor_appearance", _RUN_SQL + """,
lvs AS (SELECT DISTINCT time_point, lv FROM lg),
dm AS (SELECT time_point, CASE time_point WHEN 2 THEN 'region_' WHEN 3 THEN 'band_' ELSE 'segment_' END || replace(lower(lv), ' ', '_') AS term
       FROM (SELECT *, row_number() OVER (PARTITION BY time_point ORDER BY lv) AS r FROM lvs) WHERE r > 1)
SELECT s.scenario, term, count(*) AS appearances, CAST(min(time_point) AS INTEGER) AS first_time_point,
       CAST(count(*) AS DOUBLE) / (5 - min(time_point)) AS proportion
FROM dm, (SELECT DISTINCT scenario FROM sc) s GROUP BY ALL
""")
def q_factor_appearance(spark, sf_dir):
    """A20 + A21 + J4 + T4: in how many of the models each term occurs, and as a share of the time points it could."""
    sel = _factor_run(spark, sf_dir)[1]
    first = ch.first_time_points(spark, _factor_design(spark, sf_dir), TIME_POINTS)
    return ch.appearance(sel, first, len(TIME_POINTS)).orderBy("scenario", "proportion", "term")


_LEVELS_SQL = _LOW_SQL + f""",
base AS (SELECT final AS y, segment, region, {_BAND} AS band FROM prepared),
lg AS (SELECT 'segment' AS feature, y, segment AS lv FROM base UNION ALL SELECT 'region', y, region FROM base
       UNION ALL SELECT 'band', y, band FROM base),
gn AS (SELECT feature, lv, count(*) AS n, avg(CAST(y AS DOUBLE)) AS p FROM lg GROUP BY feature, lv),
gm AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY lv) AS r FROM gn)
"""


@register("factor_model_comparison", _LEVELS_SQL + """
SELECT feature AS model, CAST(count(*) AS BIGINT) AS k, round(-2 * sum(n * (p * ln(p) + (1 - p) * ln(1 - p))) + 2 * count(*), 6) AS aic,
       round(-2 * sum(n * (p * ln(p) + (1 - p) * ln(1 - p))), 6) AS deviance, TRUE AS converged FROM gm GROUP BY feature
""")
def q_factor_comparison(spark, sf_dir):
    """G14 + G9: named formulas, fitted in one batch, compared by AIC."""
    des = _factor_design(spark, sf_dir)
    fits = compare_models(des.df, {f: des.terms[f] for f in ("segment", "region", "band")}, "final")
    return spark.createDataFrame([(n, f.rank, round(float(f.aic()), 6), round(float(f.deviance), 6), f.converged) for n, f in fits.items()],
                                 "model string, k long, aic double, deviance double, converged boolean")


@register("factor_screen", _LEVELS_SQL + """
SELECT g.feature, g.feature || '_' || replace(lower(g.lv), ' ', '_') AS term,
       round(ln(g.p / (1 - g.p)) - ln(b.p / (1 - b.p)), 6) AS estimate,
       round((ln(g.p / (1 - g.p)) - ln(b.p / (1 - b.p))) / sqrt(1 / (g.n * g.p * (1 - g.p)) + 1 / (b.n * b.p * (1 - b.p))), 6) AS statistic,
       abs((ln(g.p / (1 - g.p)) - ln(b.p / (1 - b.p))) / sqrt(1 / (g.n * g.p * (1 - g.p)) + 1 / (b.n * b.p * (1 - b.p)))) >= 1.959963984540054 AS significant
FROM gm g JOIN gm b ON g.feature = b.feature AND b.r = 1 WHERE g.r > 1
""")
def q_factor_screen(spark, sf_dir):
    """G13 + D10: one logit per factor in one batch; Wald z of every dummy and whether its p-value is at most .05."""
    des = _factor_design(spark, sf_dir)
    fits = univariable_screen(des.df, {f: des.terms[f] for f in ("segment", "region", "band")}, "final")
    rows = [(f, term, round(est, 6), round(z, 6), p <= 0.05)
            for f, fit in fits.items() for _, term, est, _, z, p, _ in glm.coefficient_rows(fit, f)[1:]]
    return spark.createDataFrame(rows, "feature string, term string, estimate double, statistic double, significant boolean")


@register("binary_predictor_curve", _LOW_SQL + """,
g AS (SELECT segment = 'BUILDING' AS x, avg(CAST(final AS DOUBLE)) AS p FROM prepared GROUP BY 1),
c AS (SELECT max(ln(p / (1 - p))) FILTER (WHERE NOT x) AS b0, max(ln(p / (1 - p))) FILTER (WHERE x) AS b1 FROM g)
SELECT CAST(range AS DOUBLE) AS x, round(1 / (1 + exp(-(b0 + (b1 - b0) * range))), 6) AS probability FROM range(0, 101), c
""")
def q_binary_curve(spark, sf_dir):
    """One-predictor logit and its probability curve over 0..100."""
    des = _factor_design(spark, sf_dir)
    f = glm.fit(des.df, ["segment_building"], "final")
    eta = F.lit(float(f.beta[0])) + F.lit(float(f.beta[1])) * F.col("x")
    return (spark.range(0, 101).select(F.col("id").cast("double").alias("x"))
            .select("x", F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-eta)), 6).alias("probability")))


@register("interaction_saturated", _LOW_SQL + """,
r AS (SELECT segment = 'BUILDING' AS a, region = 'ASIA' AS b, final AS y,
        row_number() OVER (ORDER BY md5(concat('46:', CAST(id AS VARCHAR)))) > floor(0.8 * count(*) OVER ()) AS test FROM prepared),
g AS (SELECT a, b, count(*) AS n, avg(CAST(y AS DOUBLE)) AS p FROM r GROUP BY ALL),
k AS (SELECT count(*) AS k, round(-2 * sum(n * (p * ln(p) + (1 - p) * ln(1 - p))) + 2 * count(*), 6) AS aic FROM g),
c AS (SELECT CAST(count_if(p <= 0.5000001 AND y = 0) AS BIGINT) AS tn, CAST(count_if(p <= 0.5000001 AND y = 1) AS BIGINT) AS fn,
             CAST(count_if(p > 0.5000001 AND y = 0) AS BIGINT) AS fp, CAST(count_if(p > 0.5000001 AND y = 1) AS BIGINT) AS tp
      FROM r JOIN g ON r.a = g.a AND r.b = g.b WHERE test)
SELECT k, aic, tn, fn, fp, tp, """ + _METRICS_SQL + " FROM c, k")
def q_saturated(spark, sf_dir):
    """M10 + G2: a * b of two binary factors is saturated: fitted p is the mean of each of the four cells."""
    des = _factor_design(spark, sf_dir)
    d, names = fe.interactions(des.df, [(["segment_building"], ["region_asia"])])
    f = glm.fit(d, ["segment_building", "region_asia", *names], "final")
    test = d.where(F.col("full_test") == 1).withColumn("pred", (f.response() > ABOVE_HALF).cast("int"))
    out = mt.classification_report(test, "final", "pred")
    return out.select(F.lit(f.rank).cast("long").alias("k"), F.lit(round(float(f.aic()), 6)).alias("aic"), *out.columns)


_BUNDLE_SQL = NUMERIC_PREPARED_SQL + """,
sp AS (SELECT *, row_number() OVER (ORDER BY md5(concat('46:', CAST(id AS VARCHAR)))) AS rk, count(*) OVER () AS nn FROM prepared_num),
tr AS (SELECT acctbal AS x, final AS y, (row_number() OVER (ORDER BY md5(concat('1:', CAST(id AS VARCHAR)))) - 1) % 10 AS fold
       FROM sp WHERE rk <= floor(0.8 * nn)),
te AS (SELECT acctbal AS x, final AS y FROM sp WHERE rk > floor(0.8 * nn)),
s0 AS (SELECT count(*) AS n, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, avg(y) AS ym, regr_syy(y, x) AS tss FROM tr),
s1 AS (SELECT s0.*, (SELECT sum(power(y - b0 - b1 * x, 2)) FROM tr) AS rss FROM s0),
s2 AS (SELECT *, n * ln(tss / n) + 2 < n * ln(rss / n) + 4 AS dropped FROM s1),
md AS (SELECT n, tss, dropped, CASE WHEN dropped THEN 0 ELSE b1 END AS b1, CASE WHEN dropped THEN ym ELSE b0 END AS b0,
         CASE WHEN dropped THEN tss ELSE rss END AS rss, CASE WHEN dropped THEN 1 ELSE 2 END AS k FROM s2),
fs AS (SELECT f.fold, regr_slope(t.y, t.x) AS b1, regr_intercept(t.y, t.x) AS b0, avg(t.y) AS ym
       FROM (SELECT DISTINCT fold FROM tr) f JOIN tr t ON t.fold <> f.fold GROUP BY f.fold),
fe AS (SELECT tr.fold, avg(power(tr.y - CASE WHEN dropped THEN fs.ym ELSE fs.b0 + fs.b1 * tr.x END, 2)) AS e
       FROM tr JOIN fs ON tr.fold = fs.fold, md GROUP BY tr.fold),
pr AS (SELECT y, b0 + b1 * x AS p FROM te, md),
ct AS (SELECT CAST(count_if(y < 50 AND p < 50) AS BIGINT) AS true_fail, CAST(count_if(y < 50 AND p >= 50) AS BIGINT) AS false_pass,
         CAST(count_if(y >= 50 AND p < 50) AS BIGINT) AS false_fail, CAST(count_if(y >= 50 AND p >= 50) AS BIGINT) AS true_pass,
         round(avg(power(y - p, 2)), 6) AS test_mse FROM pr)
SELECT round(1 - (rss / (n - k)) / (tss / (n - 1)), 6) AS adj_r2, round((SELECT avg(e) FROM fe), 6) AS cv_mse,
  true_fail, false_pass, false_fail, true_pass, test_mse,
  CAST(true_fail + true_pass AS DOUBLE) / CAST(true_fail + true_pass + false_pass + false_fail AS DOUBLE) AS accuracy,
  CASE WHEN true_fail + false_pass <> 0 THEN CAST(true_fail AS DOUBLE) / CAST(true_fail + false_pass AS DOUBLE) END AS specificity,
  CASE WHEN true_fail + false_fail <> 0 THEN CAST(true_fail AS DOUBLE) / CAST(true_fail + false_fail AS DOUBLE) END AS npv,
  CASE WHEN true_pass + false_fail <> 0 THEN CAST(true_pass AS DOUBLE) / CAST(true_pass + false_fail AS DOUBLE) END AS sensitivity
FROM ct, md
"""


@register("ols_eval_bundle", _BUNDLE_SQL)
def q_ols_bundle(spark, sf_dir):
    """G5 + G6 + G7 + G8 + G9: one-predictor OLS on the training split (the predictor stays if AIC says so),
    adjusted R^2, 10-fold CV MSE, holdout MSE and pass/fail counts at 50."""
    p = prepared(spark, sf_dir, mark=None).withColumn("_lab", (F.col("final") >= 50).cast("int"))
    d, scenarios = standard_scenarios(p, label="_lab", names=("full",))
    des = ch.build_design(d, [], ["acctbal"], "_lab", scenarios)
    res = ch.chronological_linear(des, [["acctbal"]], "final")[0]
    return res.select(*[F.round(c, 6).alias(c) for c in ("adj_r2", "cv_mse")], "true_fail", "false_pass", "false_fail", "true_pass",
                      F.round("test_mse", 6).alias("test_mse"), "accuracy", "specificity", "npv", "sensitivity")


@register("ols_rstudent", _OLS_SQL + """
SELECT id, round(resid / sqrt((s2 * (n - 2) - resid * resid / (1 - h)) / (n - 3) * (1 - h)), 6) AS rstudent FROM e
""")
def q_rstudent(spark, sf_dir):
    """D7 + D3: externally studentised residual of every row of the OLS fit."""
    p, f = _ols(spark, sf_dir)
    return dg.studentised(p, f, "final").select("id", F.round("rstudent", 6).alias("rstudent"))


_FAR_SQL = NUMERIC_PREPARED_SQL + """,
s AS (SELECT regr_slope(final, acctbal) * 3000 AS b1, regr_intercept(final, acctbal) AS b0, count(*) AS n, regr_sxx(final, acctbal) / 9e6 AS sxx FROM prepared_num),
r AS (SELECT sum(power(final - (b0 + b1 / 3000 * acctbal), 2)) AS rss FROM prepared_num, s)
SELECT CAST(2 AS BIGINT) AS kept, round(b1, 6) AS slope, round(sqrt(rss / (n - 2) / sxx), 6) AS std_error, round(b1 / sqrt(rss / (n - 2) / sxx), 6) AS statistic
FROM s, r
"""


@register("ols_far_from_zero", _FAR_SQL)
def q_far_ols(spark, sf_dir):
    """G1 (alias test) + G5: OLS on a column of mean 1e6 and deviation about 1, which cross products would lose."""
    p = prepared(spark, sf_dir, mark=None).withColumn("far", F.lit(1e6) + F.col("acctbal") / 3000)
    f = glm.fit(p, ["far"], "final", "gaussian")
    row = glm.coefficient_rows(f)[-1]
    return spark.createDataFrame([(f.rank, *[round(float(v), 6) for v in row[2:5]])], "kept long, slope double, std_error double, statistic double")


@register("logit_far_from_zero", """
WITH g AS (SELECT o_orderpriority = '1-URGENT' AS x, count(*) AS n, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS p FROM orders GROUP BY 1),
c AS (SELECT max(ln(p / (1 - p))) FILTER (WHERE x) - max(ln(p / (1 - p))) FILTER (WHERE NOT x) AS b1, sqrt(sum(1 / (n * p * (1 - p)))) AS se FROM g)
SELECT CAST(2 AS BIGINT) AS kept, round(b1, 6) AS slope, round(se, 6) AS std_error, round(b1 / se, 6) AS statistic FROM c
""")
def q_far_logit(spark, sf_dir):
    """G1: logit on a 0/1 predictor moved by 1e6: slope and error are those of the group log-odds."""
    o = load(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").cast("double").alias("y"),
                                             (F.lit(1e6) + (F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("far"))
    f = glm.fit(o, ["far"], "y")
    row = glm.coefficient_rows(f)[-1]
    return spark.createDataFrame([(f.rank, *[round(float(v), 6) for v in row[2:5]])], "kept long, slope double, std_error double, statistic double")


def _poly_sql(coefficients, x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out}) * {x} + ({c!r})"
    return f"({out})"


_QQ_SQL = _OLS_SQL + f""",
pp AS (SELECT i, sample, (i - CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END) / (n + 1 - 2 * CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END) AS p
       FROM (SELECT resid AS sample, row_number() OVER (ORDER BY resid) AS i, count(*) OVER () AS n FROM e)),
q AS (SELECT *, sqrt(-2.0 * ln(p)) AS lo, sqrt(-2.0 * ln(1 - p)) AS hi, p - 0.5 AS m, (p - 0.5) * (p - 0.5) AS r FROM pp)
SELECT i, round(CASE WHEN p < 0.02425 THEN {_poly_sql(dg.QNORM_C, "lo")} / ({_poly_sql(dg.QNORM_D, "lo")} * lo + 1)
                     WHEN p > 1 - 0.02425 THEN -{_poly_sql(dg.QNORM_C, "hi")} / ({_poly_sql(dg.QNORM_D, "hi")} * hi + 1)
                     ELSE {_poly_sql(dg.QNORM_A, "r")} * m / ({_poly_sql(dg.QNORM_B, "r")} * r + 1) END, 9) AS theoretical, round(sample, 6) AS sample
FROM q
"""


@register("qq_points_rounded", _QQ_SQL)
def q_qq_rounded(spark, sf_dir):
    """Normal QQ points of the OLS residuals."""
    return dg.qq_points(_residuals(spark, sf_dir), "resid").select("i", F.round("theoretical", 9).alias("theoretical"), F.round("sample", 6).alias("sample"))
