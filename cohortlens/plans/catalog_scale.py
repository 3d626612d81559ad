"""Registered queries over the largest fact table (``lineitem``): the profile,
correlation, ROC/AUC and least-squares operators on a table that grows with
the scale factor (600k rows at sf0.1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import glm
from cohortlens.operators import metrics as mt
from cohortlens.operators import profile as pf
from cohortlens.operators import wide
from cohortlens.operators.linear import gram
from cohortlens.plans.registry import register
from cohortlens.sources.tables import load

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("lineitem_corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, " + ("CAST(1.0 AS DOUBLE) AS r" if a == b else f"round(corr({a}, {b}), 9) AS r FROM lineitem")
    for a in _NUM for b in _NUM))
def q_li_corr(spark, sf_dir):
    """A7 at scale: correlation matrix of the lineitem measures (one pass)."""
    return pf.correlation_matrix(load(spark, sf_dir, "lineitem"), _NUM)


@register("lineitem_summary", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", min({c}) AS min, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median,
        round(avg({c}), 6) AS mean, quantile_cont({c}, 0.75) AS q3, max({c}) AS max, CAST(count_if({c} IS NULL) AS BIGINT) AS n_null
        FROM lineitem""" for c in _NUM))
def q_li_summary(spark, sf_dir):
    """A13 at scale: exact type-7 quartiles by distributed selection."""
    out = pf.numeric_summary(load(spark, sf_dir, "lineitem"), _NUM)
    return out.withColumn("mean", F.round("mean", 6))


_LI_SCORE = "(l_discount + l_tax)"


@register("lineitem_auc", f"""
WITH s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS final, {_LI_SCORE} AS score FROM lineitem),
au AS (SELECT score, CAST(count_if(final = 1) AS BIGINT) AS pos, CAST(count_if(final = 0) AS BIGINT) AS neg FROM s GROUP BY score),
ac AS (SELECT pos, neg, sum(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS neg_cum FROM au),
uu AS (SELECT sum(pos * (neg_cum - neg * 0.5)) AS u, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM ac),
ad AS (SELECT CASE WHEN median(score) FILTER (WHERE final = 0) > median(score) FILTER (WHERE final = 1)
              THEN '>' ELSE '<' END AS direction FROM s)
SELECT CASE WHEN direction = '<' THEN u / (CAST(n_pos AS DOUBLE) * CAST(n_neg AS DOUBLE))
            ELSE 1.0 - u / (CAST(n_pos AS DOUBLE) * CAST(n_neg AS DOUBLE)) END AS auc, direction, n_pos, n_neg
FROM uu, ad
""")
def q_li_auc(spark, sf_dir):
    """W2 at scale: exact AUC of discount + tax for returned lines (heavy ties)."""
    li = load(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("final"),
        (F.col("l_discount") + F.col("l_tax")).alias("score"))
    return mt.auc(li, "final", "score")


@register("lineitem_ols", """
WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b1, regr_intercept(l_extendedprice, l_quantity) AS b0
           FROM lineitem)
SELECT '(Intercept)' AS term, round(b0, 6) AS estimate FROM s
UNION ALL SELECT 'l_quantity', round(b1, 6) FROM s
""")
def q_li_ols(spark, sf_dir):
    """G5 at scale: OLS by one Gram pass (extended price on quantity)."""
    g = gram(load(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")
    f = g.solve(["l_quantity"])
    return spark.createDataFrame([(n, round(float(b), 6)) for n, b in f.coefficients().items()],
                                 "term string, estimate double")


@register("lineitem_logit_flags", """
WITH g AS (SELECT l_linestatus AS lv, count(*) AS n,
                  avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS p FROM lineitem GROUP BY 1),
b AS (SELECT * FROM g ORDER BY lv LIMIT 1)
SELECT '(Intercept)' AS term, round(ln(p / (1 - p)), 6) AS estimate FROM b
UNION ALL SELECT 'l_linestatus_' || lower(g.lv), round(ln(g.p / (1 - g.p)) - ln(b.p / (1 - b.p)), 6) FROM g, b WHERE g.lv <> b.lv
""")
def q_li_logit(spark, sf_dir):
    """G1 at scale: batched IRLS logistic fit (returned ~ line status) over
    every lineitem row; closed form = group log-odds."""
    from cohortlens.operators import features as fe
    li = load(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"),
                                                "l_linestatus")
    enc = fe.fit_encoding(li, ["l_linestatus"])
    f = glm.fit(fe.one_hot(li, enc), enc.columns["l_linestatus"], "y")
    return spark.createDataFrame([(n, round(float(b), 6)) for n, b in f.coefficients().items()],
                                 "term string, estimate double")


@register("events_value_summary", """
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd
FROM events GROUP BY event_type
""")
def q_ev_summary(spark, sf_dir):
    """A14 per event type: mean and sd of the event value."""
    ev = load(spark, sf_dir, "events")
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"),
                                        F.round(F.stddev_samp("value"), 6).alias("sd"))


@register("ols_wide_factor", """
WITH c AS (SELECT l_partkey AS lv, l_quantity - avg(l_quantity) OVER (PARTITION BY l_partkey) AS x,
             l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_partkey) AS y FROM lineitem),
s AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy, count(*) AS n, count(DISTINCT lv) AS k FROM c)
SELECT k AS n_levels, k + 1 AS rank, round(b, 6) AS slope, round(sqrt((syy - b * sxy) / (n - k - 1) / sxx), 6) AS std_error FROM s
""")
def q_wide_ols(spark, sf_dir):
    """M7 + G5: extended price on quantity with an effect for every part: the levels are a table, not columns."""
    f = wide.fit_wide(load(spark, sf_dir, "lineitem"), "l_partkey", ["l_quantity"], "l_extendedprice", "gaussian")
    _, b, se = f.columns[0]
    return spark.createDataFrame([(f.n_levels, f.rank, round(b, 6), round(se, 6))], "n_levels long, rank long, slope double, std_error double")


@register("logit_wide_factor", """
WITH g AS (SELECT o_custkey AS lv, count(*) AS n, count_if(o_orderstatus = 'F') AS s FROM orders GROUP BY 1)
SELECT count(*) AS n_levels, CAST(count_if(s = 0 OR s = n) AS BIGINT) AS separated,
       round(-2 * sum(CASE WHEN s > 0 AND s < n THEN s * ln(s / n) + (n - s) * ln((n - s) / n) ELSE 0 END), 4) AS deviance, TRUE AS converged FROM g
""")
def q_wide_logit(spark, sf_dir):
    """M7 + G1 + G9: status F on a factor with a level for every customer."""
    f = _wide_logit(spark, sf_dir)
    return spark.createDataFrame([(f.n_levels, f.separated, round(f.deviance, 4), f.converged)],
                                 "n_levels long, separated long, deviance double, converged boolean")


@register("logit_wide_levels", """
WITH g AS (SELECT o_custkey AS lv, count(*) AS n, count_if(o_orderstatus = 'F') AS s FROM orders GROUP BY 1)
SELECT lv AS level, n, CASE WHEN s > 0 AND s < n THEN round(ln(s / (n - s)), 6) END AS estimate,
       CASE WHEN s > 0 AND s < n THEN round(sqrt(1.0 / s + 1.0 / (n - s)), 6) END AS std_error FROM g
""")
def q_wide_levels(spark, sf_dir):
    """D10 + M7: coefficient and standard error of every level; none where all its rows are alike."""
    t = _wide_logit(spark, sf_dir).levels
    return t.select("level", "n", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"))


def _wide_logit(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").cast("double").alias("y"))
    return wide.fit_wide(o, "o_custkey", [], "y")
