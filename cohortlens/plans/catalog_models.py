"""Registered queries: model fitting, selection, diagnostics and the
chronological/scenario runs.

Oracle SQL is given where a closed form exists: a factor-only logistic model
has fitted probability = group mean (coefficients, AIC, leverage 1/n_g,
Cook's distance follow); one-predictor OLS has ``regr_*``.  Searches,
cross-validation and SVMs have no SQL form (rows-only check).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import diagnostics as dg
from cohortlens.operators import features as fe
from cohortlens.operators import glm
from cohortlens.operators import metrics as mt
from cohortlens.operators import profile as pf
from cohortlens.operators.linear import gram, stepwise_gram
from cohortlens.operators.sampling import split_train_test
from cohortlens.operators.selection import Search, compare_models, stepwise_many, univariable_screen
from cohortlens.plans import chronological as ch
from cohortlens.plans.common import (CATEGORICAL, DEMOGRAPHIC, NUMERIC_PREPARED_SQL, PRECOURSE, PREPARED_SQL,
                                     WEEKLY_FRAGMENTS, WEEKS, cached, prepared, with_score)
from cohortlens.plans.registry import register
from cohortlens.plans.scenarios import (VARIANTS, preparation_variants, standard_scenarios, variant_scenarios, year_pair_scenarios,
                                        year_train_scenarios)
from cohortlens.sources.tables import load, student_wide

NUMERICS = ["acctbal", *WEEKS]
SETS = fe.arrival_sets(DEMOGRAPHIC, PRECOURSE, WEEKLY_FRAGMENTS)
REDUCED_SETS = fe.arrival_sets(DEMOGRAPHIC, PRECOURSE, fe.reduced_calendar(WEEKLY_FRAGMENTS, 8, last=[WEEKS[7]]))
GAMMA, COST = 0.01831563888873418, 1.0  # e^-4 and 1: the reference's fixed SVM cell
_LOGISTIC_METRICS = ["auc", "accuracy", "specificity", "sensitivity", "npv", "fn", "fp", "cv_error"]
SVM_COSTS = [1.0, 10.0, 100.0, 500.0, 1000.0]
SVM_GAMMAS = [2.718281828459045 ** (-10 + i) for i in range(11)]

# ---------------------------------------------------------------- closed-form checks

_FACTOR_SQL = """
WITH g0 AS (SELECT o_orderpriority AS lv, count(*) AS n,
                   avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS p FROM orders GROUP BY 1),
g AS (SELECT *, trim(lower(regexp_replace(lv, '[^0-9A-Za-z]+', '_', 'g')), '_') AS s FROM g0),
b AS (SELECT * FROM g ORDER BY lv LIMIT 1)
"""


def _orders_design(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").cast("double").alias("y"),
                                             "o_orderpriority")
    enc = fe.fit_encoding(o, ["o_orderpriority"])
    return fe.one_hot(o, enc, keep_factors=True), enc.columns["o_orderpriority"]


@register("logit_factor_coefficients", _FACTOR_SQL + """,
t AS (SELECT '(Intercept)' AS term, ln(p / (1 - p)) AS estimate, sqrt(1 / (n * p * (1 - p))) AS std_error FROM b
      UNION ALL
      SELECT 'o_orderpriority_' || CASE WHEN regexp_matches(g.s, '^[0-9]') THEN 'x' || g.s ELSE g.s END,
             ln(g.p / (1 - g.p)) - ln(b.p / (1 - b.p)),
             sqrt(1 / (g.n * g.p * (1 - g.p)) + 1 / (b.n * b.p * (1 - b.p))) FROM g, b WHERE g.lv <> b.lv)
SELECT term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error,
       round(estimate / std_error, 6) AS statistic, round(exp(estimate), 6) AS odds_ratio FROM t
""")
def q_logit_coef(spark, sf_dir):
    """G1 + D10 + G15: unpenalised logistic fit (status F ~ priority) on
    ``orders``: estimates, standard errors, Wald z, odds ratios."""
    x, cols = _orders_design(spark, sf_dir)
    f = glm.fit(x, cols, "y")
    t = glm.coefficient_table(spark, f)
    return t.select("term", *[F.round(c, 6).alias(c) for c in ("estimate", "std_error")],
                    F.round("statistic", 6).alias("statistic"), F.round("odds_ratio", 6).alias("odds_ratio"))


@register("logit_factor_aic", _FACTOR_SQL + """
SELECT round(-2 * sum(n * (p * ln(p) + (1 - p) * ln(1 - p))) + 2 * count(*), 6) AS aic,
       round(-2 * sum(n * (p * ln(p) + (1 - p) * ln(1 - p))), 6) AS deviance,
       CAST(count(*) AS INTEGER) AS rank FROM g
""")
def q_logit_aic(spark, sf_dir):
    """AIC = deviance + 2k of the factor-only logistic fit."""
    x, cols = _orders_design(spark, sf_dir)
    f = glm.fit(x, cols, "y")
    return spark.createDataFrame([(round(float(f.aic()), 6), round(float(f.deviance), 6), int(f.rank))],
                                 "aic double, deviance double, rank int")


@register("logit_factor_influence", _FACTOR_SQL + """,
k AS (SELECT count(*) AS k, sum(n) AS total FROM g),
yv AS (SELECT 0.0 AS y UNION ALL SELECT 1.0),
c AS (SELECT o_orderpriority AS lv, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y, count(*) AS n
      FROM orders GROUP BY ALL)
SELECT c.lv AS o_orderpriority, CAST(c.y AS DOUBLE) AS y, c.n,
       round(g.p, 9) AS fitted, round(ln(g.p / (1 - g.p)), 9) AS eta, round(1.0 / g.n, 9) AS leverage,
       round(power(((c.y - g.p) / sqrt(g.p * (1 - g.p))) / (1 - 1.0 / g.n), 2) * (1.0 / g.n) / k.k, 9) AS cooks_d,
       round(4.0 / (k.total - k.k - 1), 9) AS cutoff
FROM c JOIN g ON c.lv = g.lv, k
""")
def q_logit_influence(spark, sf_dir):
    """D1 + D3 + D4: fitted value, link, leverage and Cook's distance of every
    row of the factor-only logistic fit (summarised per distinct row type)."""
    x, cols = _orders_design(spark, sf_dir)
    f = glm.fit(x, cols, "y")
    infl = dg.with_influence(x, f, "y")
    cut = dg.cooks_cutoff(f)
    return infl.groupBy("o_orderpriority", "y").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("fitted"), 9).alias("fitted"), F.round(F.max("eta"), 9).alias("eta"),
        F.round(F.max("h"), 9).alias("leverage"), F.round(F.max("cooks_d"), 9).alias("cooks_d"),
        F.round(F.lit(cut), 9).alias("cutoff"))


_OLS_SQL = NUMERIC_PREPARED_SQL + """,
s AS (SELECT regr_slope(final, acctbal) AS b1, regr_intercept(final, acctbal) AS b0, count(*) AS n,
             avg(acctbal) AS xb, regr_sxx(final, acctbal) AS sxx FROM prepared_num),
r AS (SELECT sum(power(final - (b0 + b1 * acctbal), 2)) AS rss FROM prepared_num, s),
e AS (SELECT id, acctbal, final - (b0 + b1 * acctbal) AS resid,
             1.0 / n + power(acctbal - xb, 2) / sxx AS h, rss / (n - 2) AS s2, n FROM prepared_num, s, r)
"""


def _ols(spark, sf_dir):
    p = prepared(spark, sf_dir, mark=None)
    return p, glm.fit(p, ["acctbal"], "final", "gaussian")


@register("ols_one_predictor", _OLS_SQL + """
SELECT '(Intercept)' AS term, round(b0, 6) AS estimate, round(sqrt(rss / (n - 2) * (1.0 / n + xb * xb / sxx)), 6) AS std_error,
       round(b0 / sqrt(rss / (n - 2) * (1.0 / n + xb * xb / sxx)), 6) AS statistic FROM s, r
UNION ALL
SELECT 'acctbal', round(b1, 6), round(sqrt(rss / (n - 2) / sxx), 6), round(b1 / sqrt(rss / (n - 2) / sxx), 6) FROM s, r
""")
def q_ols(spark, sf_dir):
    """G5 + D10: OLS of final on acctbal (estimate, se, t)."""
    _, f = _ols(spark, sf_dir)
    t = glm.coefficient_table(spark, f)
    return t.select("term", *[F.round(c, 6).alias(c) for c in ("estimate", "std_error", "statistic")])


@register("ols_influence", _OLS_SQL + """
SELECT id, round(resid, 9) AS resid, round(h, 9) AS leverage,
       round(resid * resid * h / (s2 * 2 * power(1 - h, 2)), 9) AS cooks_d,
       resid * resid * h / (s2 * 2 * power(1 - h, 2)) > 4.0 / (n - 2 - 1) AS influential FROM e
""")
def q_ols_influence(spark, sf_dir):
    """D2 + D3 + D4 + P14: residual, leverage, Cook's distance and the
    cut-off flag of every training row."""
    p, f = _ols(spark, sf_dir)
    infl = dg.with_influence(p, f, "final")
    cut = dg.cooks_cutoff(f)
    return infl.select("id", F.round("resid", 9).alias("resid"), F.round("h", 9).alias("leverage"),
                       F.round("cooks_d", 9).alias("cooks_d"), (F.col("cooks_d") > F.lit(cut)).alias("influential"))


_HL_SQL = PREPARED_SQL + """,
q AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS qs FROM scored),
hb AS (SELECT 1 + """ + " + ".join(f"CAST(score > qs[{i}] AS INTEGER)" for i in range(1, 10)) + """ AS bin, final, score
       FROM scored, q),
hg AS (SELECT bin, count(*) AS n, CAST(sum(final) AS DOUBLE) AS observed, sum(score) AS expected FROM hb GROUP BY bin)
"""


@register("hosmer_lemeshow_bins", _HL_SQL + """
SELECT bin, n, observed, round(expected, 9) AS expected FROM hg
""")
def q_hl_bins(spark, sf_dir):
    """D6 (table): observed and expected passes per decile group of the score."""
    b = dg.hosmer_lemeshow_bins(with_score(prepared(spark, sf_dir)), "final", "score")
    return b.withColumn("expected", F.round("expected", 9))


@register("hosmer_lemeshow", _HL_SQL + """,
x AS (SELECT sum(power(observed - expected, 2) / expected
                 + power((n - observed) - (n - expected), 2) / (n - expected)) AS chisq FROM hg)
SELECT round(chisq, 6) AS chisq, 8 AS df,
       round(exp(-chisq / 2) * (1 + chisq / 2 + power(chisq / 2, 2) / 2 + power(chisq / 2, 3) / 6), 6) AS p_value FROM x
""")
def q_hl(spark, sf_dir):
    """Hosmer-Lemeshow goodness of fit, g = 10, df = 8."""
    h = dg.hosmer_lemeshow(with_score(prepared(spark, sf_dir)), "final", "score")
    return h.select(F.round("chisq", 6).alias("chisq"), "df", F.round("p_value", 6).alias("p_value"))


def _residuals(spark, sf_dir):
    p, f = _ols(spark, sf_dir)
    return dg.with_fitted(p, f, "final")


@register("jarque_bera_residuals", _OLS_SQL + """,
m AS (SELECT avg(resid) AS mu, count(*) AS n FROM e),
mo AS (SELECT avg(power(resid - mu, 2)) AS m2, avg(power(resid - mu, 3)) AS m3, avg(power(resid - mu, 4)) AS m4,
              max(m.n) AS n FROM e, m),
jb AS (SELECT n, m3 / power(m2, 1.5) AS sk, m4 / (m2 * m2) - 3 AS ku FROM mo)
SELECT n, round(sk, 6) AS skewness, round(ku, 6) AS kurtosis, round(n / 6.0 * (sk * sk + ku * ku / 4), 6) AS jb,
       round(exp(-(n / 6.0 * (sk * sk + ku * ku / 4)) / 2), 6) AS p_value FROM jb
""")
def q_jb(spark, sf_dir):
    """D9 (Shapiro-Wilk re-aimed): Jarque-Bera normality test of OLS residuals."""
    j = dg.jarque_bera(_residuals(spark, sf_dir), "resid")
    return j.select("n", *[F.round(c, 6).alias(c) for c in ("skewness", "kurtosis", "jb", "p_value")])


_MAXLAG = 60


@register("residual_acf", _OLS_SQL + """,
m AS (SELECT avg(resid) AS mu, count(*) AS n FROM e),
c AS (SELECT id, resid - mu AS c FROM e, m),
l AS (SELECT c, """ + ", ".join(f"lag(c, {k}) OVER (ORDER BY id) AS l{k}" for k in range(1, _MAXLAG + 1)) + """ FROM c),
sm AS (SELECT sum(c * c) AS s0, """ + ", ".join(f"sum(c * l{k}) AS s{k}" for k in range(1, _MAXLAG + 1)) + """ FROM l)
SELECT lag, round(acf, 9) AS acf FROM (
  SELECT 0 AS lag, 1.0 AS acf UNION ALL """ + " UNION ALL ".join(
    f"SELECT {k}, s{k} / s0 FROM sm" for k in range(1, _MAXLAG + 1)) + """) a, m
WHERE lag <= floor(10 * log10(m.n))
""")
def q_acf(spark, sf_dir):
    """Autocorrelation of OLS residuals in id order, lags 0..10 log10 n."""
    a = dg.acf(_residuals(spark, sf_dir), "resid", "id")
    return a.select("lag", F.round("acf", 9).alias("acf"))


@register("residual_density_overlay", _OLS_SQL + """,
st AS (SELECT avg(resid) AS m, stddev_samp(resid) AS sd FROM e)
SELECT CAST(x AS INTEGER) AS x, round(exp(-0.5 * power((x - m) / sd, 2)) / (sd * sqrt(2 * pi())), 12) AS density
FROM range(-40, 41) r(x), st
""")
def q_overlay(spark, sf_dir):
    """Normal density at -40..40 with the residuals' mean and sd."""
    d = dg.density_overlay(_residuals(spark, sf_dir), "resid")
    return d.select("x", F.round("density", 12).alias("density"))


_TAU = 0.3


@register("prior_corrected_scores", PREPARED_SQL + f""",
yb AS (SELECT avg(CASE WHEN final = 0 THEN 1.0 ELSE 0.0 END) AS ybar FROM scored)
SELECT id, round(1 / (1 + exp(-(ln(score / (1 - score)) - ln(((1 - {_TAU}) / {_TAU}) * (ybar / (1 - ybar)))))), 9)
       AS score_corrected FROM scored, yb
""")
def q_prior(spark, sf_dir):
    """Case-control prior correction of a probability (tau = 0.3), with
    ybar the class-0 share of the scored rows."""
    s = with_score(prepared(spark, sf_dir))
    ybar = s.agg(F.avg((F.col("final") == 0).cast("double"))).first()[0]
    return s.select("id", F.round(ch._prior_corrected(F.col("score"), _TAU, F.lit(ybar)), 9).alias("score_corrected"))


_STD = ["acctbal", "w1", "w2"]


@register("standardised_features", NUMERIC_PREPARED_SQL + """,
st AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _STD) + """ FROM prepared_num)
SELECT id, """ + ", ".join(f"round(({c} - m_{c}) / s_{c}, 9) AS {c}" for c in _STD) + """ FROM prepared_num, st
""")
def q_standardise(spark, sf_dir):
    """M6: (x - mean) / sd over all rows."""
    s = fe.standardise(prepared(spark, sf_dir, mark=None), _STD)
    return s.select("id", *[F.round(c, 9).alias(c) for c in _STD])


@register("treatment_dummies", PREPARED_SQL + """
SELECT id, """ + ", ".join(
    f"CAST(segment = '{v}' AS DOUBLE) AS segment_{v.lower()}" for v in ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]) + ", " + \
    ", ".join(f"CAST(region = '{v}' AS DOUBLE) AS region_{v.lower().replace(' ', '_')}"
              for v in ["AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]) + """ FROM prepared
""")
def q_dummies(spark, sf_dir):
    """M7: treatment-contrast dummies, first (alphabetical) level dropped,
    levels read from the full table."""
    p = prepared(spark, sf_dir)
    enc = fe.fit_encoding(p, CATEGORICAL)
    return fe.one_hot(p, enc).select("id", *enc.columns["segment"], *enc.columns["region"])


@register("interaction_columns", PREPARED_SQL + """
SELECT id, CAST(segment = 'BUILDING' AS DOUBLE) * CAST(region = 'ASIA' AS DOUBLE) AS segment_building__x__region_asia,
       CAST(segment = 'BUILDING' AS DOUBLE) * acctbal AS segment_building__x__acctbal FROM prepared
""")
def q_interactions(spark, sf_dir):
    """Interaction columns as products of treatment dummies / numerics."""
    p = prepared(spark, sf_dir)
    enc = fe.fit_encoding(p, CATEGORICAL)
    d, names = fe.interactions(fe.one_hot(p, enc, keep_factors=True),
                               [(["segment_building"], ["region_asia", "acctbal"])])
    return d.select("id", *names)


# ---------------------------------------------------------------- fits without SQL form

def _student_design(spark, sf_dir, which: str = "standard"):
    return cached(spark, sf_dir, f"design:{which}", lambda: _build_design(spark, sf_dir, which))


def _build_design(spark, sf_dir, which):
    p = prepared(spark, sf_dir)
    if which == "svm":  # every numeric column scaled before encoding; a constant one says nothing
        p = fe.standardise(p, NUMERICS).fillna(0.0, subset=list(NUMERICS))
    if which in ("standard", "svm"):
        d, scen = standard_scenarios(p)
    else:
        d, scen = year_pair_scenarios(p)
    return ch.build_design(d, CATEGORICAL, NUMERICS, "final", scen)


@register("logit_univariable_screen")
def q_screen(spark, sf_dir):
    """One logistic fit per candidate predictor (all in one batch);
    p-value of the first non-intercept coefficient, significant terms flagged."""
    des = _student_design(spark, sf_dir)
    fits = univariable_screen(des.df, des.terms, "final")
    rows = []
    for term, f in fits.items():
        for r in glm.coefficient_rows(f, term)[1:]:
            rows.append((term, r[1], r[2], r[5], None if r[5] is None else r[5] <= 0.05, f.converged))
    return spark.createDataFrame(rows, "feature string, term string, estimate double, p_value double, "
                                       "significant boolean, converged boolean")


@register("logit_compare_models")
def q_compare(spark, sf_dir):
    """Manual backward elimination -- named formulas compared by AIC."""
    des = _student_design(spark, sf_dir)
    t = des.terms
    full = [c for tm in ["segment", "region", "acctbal", *WEEKS] for c in t[tm]]
    forms = {"full_model": full,
             "m2": [c for tm in ["acctbal", *WEEKS] for c in t[tm]],
             "m3": [c for tm in ["acctbal", *WEEKS[:8]] for c in t[tm]],
             "m4": [c for tm in ["region", "acctbal", "w1", "w2", "w3", "w4"] for c in t[tm]],
             "m5": [c for tm in ["acctbal", "w1", "w2"] for c in t[tm]]}
    fits = compare_models(des.df, forms, "final")
    return spark.createDataFrame([(n, f.rank, float(f.aic()), float(f.deviance), f.converged) for n, f in fits.items()],
                                 "model string, k int, aic double, deviance double, converged boolean")


@register("logit_stepwise")
def q_stepwise(spark, sf_dir):
    """Bidirectional stepAIC from the full formula on the training split."""
    des = _student_design(spark, sf_dir)
    res = stepwise_many(des.df, {"full": Search(des.terms, SETS[-1], include="full_train")}, "final")
    s = res["full"]
    return spark.createDataFrame([(i, a, t, float(aic), s.done, s.fit.converged) for i, (a, t, aic) in enumerate(s.path)],
                                 "step int, action string, term string, aic double, finished boolean, converged boolean")


@register("logit_eval_bundle")
def q_eval_bundle(spark, sf_dir):
    """G2 + G3 + G4: the full formula fitted on the training split (no
    selection), 10-fold CV misclassification, holdout confusion at p > 0.5,
    metrics and exact AUC."""
    des = _student_design(spark, sf_dir)
    full = [s for s in des.scenarios if s.name == "full"][0]
    f = glm.fit_many(des.df, {"m": glm.Spec(tuple(ch.expanded(des, SETS[-1])), include=full.train)}, "final")["m"]
    res, _ = ch.evaluate_logistic(des, [ch.Evaluated(full, len(SETS), f)])
    return res


@register("linear_eval_bundle")
def q_linear_bundle(spark, sf_dir):
    """G5 + G6 + G7 + G9: OLS on the training split (numeric final),
    10-fold CV MSE, adjusted R^2, holdout MSE and pass/fail counts at 50."""
    p = prepared(spark, sf_dir, mark=None)
    d, scen = standard_scenarios(p.withColumn("_lab", (F.col("final") >= 50).cast("int")), label="_lab")
    des = ch.build_design(d, CATEGORICAL, NUMERICS, "_lab", [s for s in scen if s.name == "full"])
    res, _ = ch.chronological_linear(des, [SETS[-1]], "final")
    return res


@register("chronological_logistic")
def q_chrono(spark, sf_dir):
    """G10 + G24: 14 time points x 4 regimes (years, full, balanced,
    balanced-train/imbalanced-test): stepAIC, CV error, holdout metrics, AUC."""
    res, _ = _chrono_logistic(spark, sf_dir)
    return res


def _chrono_logistic(spark, sf_dir):
    return cached(spark, sf_dir, "chrono_logistic",
                   lambda: ch.chronological_logistic(_student_design(spark, sf_dir), SETS))


@register("chronological_logistic_reduced")
def q_chrono_reduced(spark, sf_dir):
    """Reduced calendar (10 time points) on the six cross-year pairs,
    prior-corrected probabilities (tau = 0.3)."""
    def build():
        des = _student_design(spark, sf_dir, "pairs")
        return ch.chronological_logistic(des, REDUCED_SETS, prior_tau=_TAU)[0]
    return cached(spark, sf_dir, "chrono_reduced", build)


@register("chronological_linear")
def q_chrono_linear(spark, sf_dir):
    """Linear chronological run (numeric final), 14 time points x 4 regimes."""
    def build():
        p = prepared(spark, sf_dir, mark=None).withColumn("_lab", (F.col("final") >= 50).cast("int"))
        d, scen = standard_scenarios(p, label="_lab")
        des = ch.build_design(d, CATEGORICAL, NUMERICS, "_lab", scen)
        return ch.chronological_linear(des, SETS, "final")[0]
    return cached(spark, sf_dir, "chrono_linear", build)


@register("chronological_linear_years")
def q_chrono_linear_years(spark, sf_dir):
    """G12 + G7 + G24: linear chronological runs trained on one cohort and
    evaluated on the two other cohorts (two test sets per fit)."""
    p = prepared(spark, sf_dir, mark=None).withColumn("_lab", (F.col("final") >= 50).cast("int"))
    d, scen = year_train_scenarios(p)
    des = ch.build_design(d, CATEGORICAL, NUMERICS, "_lab", scen)
    res, _ = ch.chronological_linear(des, SETS, "final")
    return res


def _variant_design(spark, sf_dir, label: str) -> ch.Design:
    """The table of all preparation variants, with a label at one of the pass marks."""
    def build():
        d = preparation_variants(student_wide(spark, sf_dir), WEEKS, ["acctbal"], CATEGORICAL, "final", WEEKS[8:])
        d, scen = variant_scenarios(d)
        return ch.build_design(d, CATEGORICAL, NUMERICS, "pass_50", scen)
    des = cached(spark, sf_dir, "design:variants", build)
    return ch.Design(des.df, des.encoding, des.terms, label, [s for s in des.scenarios if VARIANTS[s.variant] == label])


def _by_variant(res):
    parts = F.split("scenario", "__")
    return res.withColumns({"variant": parts[0], "scenario": parts[1]})


@register("chronological_logistic_variants")
def q_chrono_variants(spark, sf_dir):
    """G11 + G24: the reduced calendar on the six cross-year pairs for every preparation variant: pass mark 50 and 55,
    missing removed after and without zero fill; one table, its rows flagged by variant."""
    def build():
        runs = [ch.chronological_logistic(_variant_design(spark, sf_dir, label), REDUCED_SETS)[0] for label in sorted(set(VARIANTS.values()))]
        return _by_variant(runs[0].unionByName(runs[1]))
    return cached(spark, sf_dir, "chrono_variants", build)


@register("chronological_linear_variants")
def q_chrono_linear_variants(spark, sf_dir):
    """G12 + G24: the linear run (numeric final) on the cross-year pairs for every variant; counts at the variant's mark."""
    def build():
        runs = [ch.chronological_linear(_variant_design(spark, sf_dir, label), REDUCED_SETS, "final", mark=float(label.split("_")[1]))[0]
                for label in sorted(set(VARIANTS.values()))]
        return _by_variant(runs[0].unionByName(runs[1]))
    return cached(spark, sf_dir, "chrono_linear_variants", build)


@register("performance_by_variant")
def q_perf_variants(spark, sf_dir):
    """A16 + G25 + G24: per-variant and -pair means of the logistic run over the time points."""
    return ch.performance_summary(q_chrono_variants(spark, sf_dir), _LOGISTIC_METRICS, by=("variant", "scenario"))


@register("performance_linear")
def q_perf_linear(spark, sf_dir):
    """A16 + G25: per-regime means of the linear run over the time points."""
    return ch.performance_summary(q_chrono_linear(spark, sf_dir), ["adj_r2", "cv_mse", "accuracy", "specificity", "npv", "sensitivity",
                                                                   "false_fail", "false_pass", "test_mse"])


@register("performance_svm")
def q_perf_svm(spark, sf_dir):
    """A16 + G25: means of the SVM runs over the time points, per setting (tuned, fixed) and regime."""
    return ch.performance_summary(q_svm_chrono(spark, sf_dir), ["auc", "accuracy", "specificity", "npv", "sensitivity", "fn", "fp"],
                                  by=("cell", "scenario"))


@register("variable_appearance")
def q_appearance(spark, sf_dir):
    """A20 + A21 + T4: selected-term appearance counts and proportions of the
    time points each term could appear in, ascending."""
    res, sel = _chrono_logistic(spark, sf_dir)
    des = _student_design(spark, sf_dir)
    first = ch.first_time_points(spark, des, SETS)
    return ch.appearance(sel, first, len(SETS)).where(F.col("appearances") > 0).orderBy("scenario", "proportion")


@register("performance_summary")
def q_perf(spark, sf_dir):
    """A16 + G25: per-regime means over the time points."""
    res, _ = _chrono_logistic(spark, sf_dir)
    return ch.performance_summary(res, _LOGISTIC_METRICS)


@register("accuracy_matrix")
def q_matrix(spark, sf_dir):
    """Accuracy as a regime x time-point matrix."""
    res, _ = _chrono_logistic(spark, sf_dir)
    return ch.metric_matrix(res, "accuracy")


@register("false_fail_rates")
def q_rates(spark, sf_dir):
    """A18 + A19: false fails/passes per time point and share of the test set."""
    res, _ = _chrono_logistic(spark, sf_dir)
    return ch.per_time_point_rates(res)


@register("svm_tuning_grid")
def q_tune(spark, sf_dir):
    """5 costs x 11 gammas, 10-fold CV misclassification, all four regimes, scaled inputs."""
    def build():
        return ch.tune_grid(_student_design(spark, sf_dir, "svm"), SETS[-1], SVM_COSTS, SVM_GAMMAS)
    return cached(spark, sf_dir, "svm_grid", build)


@register("svm_chronological")
def q_svm_chrono(spark, sf_dir):
    """Chronological SVM, all four regimes, scaled inputs, with the tuned cell of each regime's grid
    and with the fixed cell (gamma e^-4, cost 1)."""
    def build():
        best = {r["scenario"]: (r["gamma"], r["cost"]) for r in ch.best_cells(q_tune(spark, sf_dir)).collect()}
        return ch.chronological_svm(_student_design(spark, sf_dir, "svm"), SETS, {"tuned": best, "fixed": dict.fromkeys(best, (GAMMA, COST))})
    return cached(spark, sf_dir, "svm_chrono", build)


@register("svm_class_weights")
def q_svm_weights(spark, sf_dir):
    """Class-weight sweep (pass 1..10, fail 10..1) at time point 7's features, all four regimes, scaled inputs."""
    return ch.class_weight_sweep(_student_design(spark, sf_dir, "svm"), SETS[6], GAMMA, COST, list(range(1, 11)), list(range(10, 0, -1)))


@register("svm_threshold_table")
def q_svm_table(spark, sf_dir):
    """G18 + G22 + W4 + W6: weighted SVM (pass 4, fail 7) at time point 7,
    Platt probabilities from out-of-fold decisions; best threshold from the
    training ROC; three-threshold table on the held-out rows."""
    from cohortlens.operators import svm as sv
    from cohortlens.session import materialize
    des = _student_design(spark, sf_dir, "svm")
    specs = {"m": sv.svm_spec(ch.expanded(des, SETS[6]), GAMMA, COST, include="full_train", class_weights=(7.0, 4.0))}
    f = sv.fit_svms(des.df, specs, "final")
    platt = sv.cross_fitted_platt(des.df, specs, "final", {"m": "fold_full"}, start=f)["m"]
    d = sv.with_decisions(des.df, specs, f, {"m": "_dec"})
    scored = materialize(d.select("full_train", "full_test", "final", platt.probability(F.col("_dec")).alias("prob")))
    best = mt.best_threshold(mt.roc_curve(scored.where(F.col("full_train") == 1), "final", "prob")).first()["threshold"]
    return mt.threshold_table(scored.where(F.col("full_test") == 1), float(best), "final", "prob")


@register("svm_best_cell")
def q_svm_best(spark, sf_dir):
    """The best grid cell (lowest CV error)."""
    return ch.best_cells(q_tune(spark, sf_dir))


@register("svm_tuning_slices")
def q_svm_slices(spark, sf_dir):
    """CV error by gamma for each cost (pivot of the grid)."""
    return ch.tuning_slices(q_tune(spark, sf_dir))


@register("one_predictor_curve")
def q_curve(spark, sf_dir):
    """One-predictor logistic (final ~ w1) and its probability curve over x = 0..100."""
    des = _student_design(spark, sf_dir)
    f = glm.fit(des.df, ["w1"], "final")
    c = f.coefficients()
    xs = spark.range(0, 101).select(F.col("id").cast("double").alias("x"))
    eta = F.lit(c["(Intercept)"]) + F.lit(c["w1"]) * F.col("x")
    return xs.select("x", (F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))).alias("probability"))


@register("interaction_models")
def q_interaction_models(spark, sf_dir):
    """M10 + G2: main effects plus interaction (factor x factor, numeric x
    factor), fitted on all rows, classified at p > 0.5 on the test split."""
    des = _student_design(spark, sf_dir)
    t = des.terms
    d, ff = fe.interactions(des.df, [(t["segment"], t["region"])])
    d, nf = fe.interactions(d, [(["acctbal"], t["region"])])
    specs = {"segment*region": glm.Spec(tuple(t["segment"] + t["region"] + ff)),
             "acctbal*region": glm.Spec(tuple(["acctbal"] + t["region"] + nf))}
    fits = glm.fit_many(d, specs, "final")
    rows = []
    for name, f in fits.items():
        pred = (f.response() > 0.5).cast("int")
        r = d.where(F.col("full_test") == 1).agg(*mt.confusion_exprs("final", pred)).first()
        rows.append((name, f.rank, float(f.aic()), int(r["tn"]), int(r["fn"]), int(r["fp"]), int(r["tp"])))
    out = spark.createDataFrame(rows, "model string, k int, aic double, tn long, fn long, fp long, tp long")
    return mt.with_metrics(out)


@register("ks_residuals")
def q_ks(spark, sf_dir):
    """KS test of OLS residuals against N(0,1), raw and standardised."""
    r = _residuals(spark, sf_dir)
    return dg.ks_normal(r, "resid").unionByName(dg.ks_normal(r, "resid", standardise=True))


@register("outlier_test")
def q_outliers(spark, sf_dir):
    """D7 + T5: ten largest studentised residuals of the OLS fit, Bonferroni p."""
    p, f = _ols(spark, sf_dir)
    return dg.outlier_test(p, f, "final")


@register("qq_points")
def q_qq(spark, sf_dir):
    """Normal QQ points of the OLS residuals."""
    return dg.qq_points(_residuals(spark, sf_dir), "resid")


@register("linear_stepwise_gram")
def q_linear_step(spark, sf_dir):
    """G8 (linear): stepAIC on one Gram pass (no data pass per candidate)."""
    p = prepared(spark, sf_dir, mark=None)
    enc = fe.fit_encoding(p, CATEGORICAL)
    d = fe.one_hot(p, enc)
    terms = {f: enc.columns[f] for f in CATEGORICAL}
    terms.update({c: [c] for c in NUMERICS})
    g = gram(d, sorted({c for cs in terms.values() for c in cs}), "final")
    chosen, f, path = stepwise_gram(g, terms, SETS[-1])
    return spark.createDataFrame([(i, a, t, float(aic), f.extra["finished"]) for i, (a, t, aic) in enumerate(path)],
                                 "step int, action string, term string, aic double, finished boolean")


@register("flagship_evaluation")
def q_flagship(spark, sf_dir):
    """Prepare -> exact 80/20 split -> logistic fit of the full formula on the
    training rows -> score the held-out rows -> confusion at p > 0.5, exact
    AUC, and the Youden-best threshold of the training ROC, as one row."""
    from cohortlens.session import materialize
    p = prepared(spark, sf_dir)
    enc = fe.fit_encoding(p, CATEGORICAL)
    d = split_train_test(fe.one_hot(p, enc), "id", 0.8, 46)
    cols = [*enc.columns["segment"], *enc.columns["region"], *NUMERICS]
    d = d.withColumn("_train", (F.col("split") == "train").cast("int"))
    spec = glm.Spec(tuple(cols), include="_train")
    f = glm.fit_many(d, {"m": spec}, "final")["m"]
    # scored in the executor tasks: an opaque column keeps the fitted
    # expression out of the optimizer's constraint propagation
    scored = materialize(glm.score_many(d, {"prob": (spec, f)}, response=True)
                         .withColumn("pred", mt.classify("prob", 0.5, strict=True)))
    train, test = scored.where(F.col("_train") == 1), scored.where(F.col("_train") == 0)
    best = mt.best_threshold(mt.roc_curve(train, "final", "prob")).select(F.col("threshold").alias("best_threshold"))
    rep = mt.classification_report(test, "final", "pred").withColumn("_k", F.lit(1))
    a = mt.auc(test, "final", "prob").select("auc").withColumn("_k", F.lit(1))
    meta = spark.createDataFrame([(1, float(f.aic()), int(f.rank), bool(f.converged))],
                                 "_k int, aic double, rank int, converged boolean")
    return rep.join(a, "_k").join(meta, "_k").join(best.withColumn("_k", F.lit(1)), "_k").drop("_k")


@register("influential_rows", _OLS_SQL + """,
flag AS (SELECT id, resid * resid * h / (s2 * 2 * power(1 - h, 2)) AS cooks_d, n FROM e)
SELECT p.id, p.year, p.segment, p.region, p.acctbal, p.final, round(flag.cooks_d, 9) AS cooks_d,
       CASE WHEN flag.cooks_d > 0.015 THEN CAST(p.id AS VARCHAR) ELSE '' END AS label
FROM prepared_num p JOIN flag ON p.id = flag.id WHERE flag.cooks_d > 4.0 / (flag.n - 2 - 1)
""")
def q_influential(spark, sf_dir):
    """P13 + P14 + D5: rows above the Cook's-distance cut-off, looked up by
    their row key, labelled when the distance exceeds 0.015."""
    p, f = _ols(spark, sf_dir)
    infl = dg.label_influential(dg.with_influence(p, f, "final"), 0.015)
    above = infl.where(F.col("cooks_d") > F.lit(dg.cooks_cutoff(f))).select("id", "cooks_d", "label")
    rows = p.join(above, "id", "left_semi")  # lookup by row key
    return rows.join(above, "id").select("id", "year", "segment", "region", "acctbal", "final",
                                         F.round("cooks_d", 9).alias("cooks_d"), "label")


@register("relevel_dummies", PREPARED_SQL + """
SELECT id, """ + ", ".join(
    f"CAST(region = '{v}' AS DOUBLE) AS region_{v.lower().replace(' ', '_')}"
    for v in ["AFRICA", "AMERICA", "ASIA", "MIDDLE EAST"]) + """ FROM prepared
""")
def q_relevel(spark, sf_dir):
    """Treatment dummies with a chosen reference level (region base EUROPE)."""
    p = prepared(spark, sf_dir)
    enc = fe.fit_encoding(p, ["region"], base={"region": "EUROPE"})
    return fe.one_hot(p, enc).select("id", *enc.columns["region"])


@register("ols_truth_vs_fitted", _OLS_SQL + """
SELECT id, final, acctbal, round(final - resid, 9) AS fitted FROM e JOIN prepared_num USING (id, acctbal)
""")
def q_truth_fitted(spark, sf_dir):
    """D11 + P16: truth, predictor and fitted value appended to every row."""
    p, f = _ols(spark, sf_dir)
    return dg.with_fitted(p, f).select("id", "final", "acctbal", F.round("fitted", 9).alias("fitted"))


@register("scores_sorted", PREPARED_SQL + "SELECT id, final, score FROM scored ORDER BY score, id")
def q_sorted(spark, sf_dir):
    """Rows ordered by score (for output; the sweep itself needs no sort)."""
    return with_score(prepared(spark, sf_dir)).select("id", "final", "score").orderBy("score", "id")


_HIST_SQL = NUMERIC_PREPARED_SQL + """,
st AS (SELECT count(final) AS n, min(final) AS lo, max(final) AS hi FROM prepared_num),
c0 AS (SELECT n, lo, hi, (hi - lo) / ceil(log2(n) + 1) AS cell FROM st),
c1 AS (SELECT *, pow(10, floor(log10(cell))) AS base FROM c0),
c2 AS (SELECT *, CASE WHEN NOT (2 * base - cell < 1.5 * (cell - base)) THEN base
                      WHEN NOT (5 * base - cell < 2.75 * (cell - 2 * base)) THEN 2 * base
                      WHEN NOT (10 * base - cell < 1.5 * (cell - 5 * base)) THEN 5 * base
                      ELSE 10 * base END AS unit FROM c1),
c3 AS (SELECT *, floor(lo / unit + 1e-10) AS ns0 FROM c2),
c4 AS (SELECT *, CASE WHEN ns0 * unit > lo + 1e-10 * unit THEN ns0 - 1 ELSE ns0 END AS ns FROM c3),
b AS (SELECT greatest(1, CAST(ceil((final - ns * unit - 1e-7 * unit) / unit) AS INTEGER)) AS bin, ns, unit, n
      FROM prepared_num, c4)
"""


@register("final_histogram", _HIST_SQL + """
SELECT bin, round(ns * unit + (bin - 1) * unit, 9) AS lower, round(ns * unit + bin * unit, 9) AS upper,
       count(*) AS count, round(count(*) / (max(n) * max(unit)), 12) AS density
FROM b GROUP BY bin, ns, unit
""")
def q_hist(spark, sf_dir):
    """Density histogram of the final mark (Sturges classes, pretty
    breaks, right-closed bins, lowest included)."""
    h = pf.density_histogram(prepared(spark, sf_dir, mark=None), "final")
    return h.select("bin", F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"), "count",
                    F.round("density", 12).alias("density"))


@register("year_pair_means")
def q_pair_means(spark, sf_dir):
    """Mean of the two runs that share a training cohort (tested on the
    two other cohorts), over the reduced-calendar time-point means."""
    res = q_chrono_reduced(spark, sf_dir)
    perf = ch.performance_summary(res, ["auc", "accuracy", "specificity", "fn"])
    pairs = {f"train_{y}": [f"y{y}_on_{o}" for o in (2015, 2016, 2017) if o != y] for y in (2015, 2016, 2017)}
    return ch.pair_means(perf, pairs, ["mean_auc", "mean_accuracy", "mean_specificity", "mean_fn"])


@register("ols_cv_mse", NUMERIC_PREPARED_SQL + """,
fo AS (SELECT *, (row_number() OVER (ORDER BY md5(concat('1:', CAST(id AS VARCHAR)))) - 1) % 10 AS fold
       FROM prepared_num),
fs AS (SELECT fold, count(*) AS n, sum(acctbal) AS sx, sum(final) AS sy, sum(acctbal * acctbal) AS sxx,
              sum(acctbal * final) AS sxy, sum(final * final) AS syy FROM fo GROUP BY fold),
t AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM fs),
c AS (SELECT fs.*, t.n - fs.n AS cn, t.sx - fs.sx AS csx, t.sy - fs.sy AS csy, t.sxx - fs.sxx AS csxx,
             t.sxy - fs.sxy AS csxy FROM fs, t),
b AS (SELECT *, (cn * csxy - csx * csy) / (cn * csxx - csx * csx) AS b1 FROM c),
a AS (SELECT *, (csy - b1 * csx) / cn AS b0 FROM b)
SELECT round(avg((syy - 2 * b0 * sy - 2 * b1 * sxy + n * b0 * b0 + 2 * b0 * b1 * sx + b1 * b1 * sxx) / n), 6)
       AS cv_mse FROM a
""")
def q_ols_cv(spark, sf_dir):
    """10-fold CV MSE (mean of fold MSEs) of final ~ acctbal, from one
    Gram pass with per-fold partials (train Gram = total - fold)."""
    from cohortlens.operators.sampling import assign_folds
    p = assign_folds(prepared(spark, sf_dir, mark=None), 10, "id", 1)
    g = gram(p, ["acctbal"], "final", "fold")
    return spark.createDataFrame([(round(float(g.cv_mse(["acctbal"])), 6),)], "cv_mse double")
