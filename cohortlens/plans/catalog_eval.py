"""Registered queries: evaluation metrics, ROC/AUC and threshold analysis.

The score is model-free (``common.with_score``) so the oracle can compute it
exactly in SQL; model-fitted scores use the same operators (catalog_models).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions.columns import round_half_even
from cohortlens.operators import metrics as mt
from cohortlens.operators import sampling as sm
from cohortlens.plans.common import PREPARED_SQL, prepared, with_score
from cohortlens.plans.registry import register

_METRICS_SQL = """
  CASE WHEN (tn+fn+fp+tp) <> 0 THEN CAST(tn+tp AS DOUBLE) / CAST(tn+fn+fp+tp AS DOUBLE) END AS accuracy,
  1.0 - CASE WHEN (tn+fn+fp+tp) <> 0 THEN CAST(tn+tp AS DOUBLE) / CAST(tn+fn+fp+tp AS DOUBLE) END AS misclassification,
  CASE WHEN tn+fp <> 0 THEN CAST(tn AS DOUBLE) / CAST(tn+fp AS DOUBLE) END AS specificity,
  CASE WHEN tp+fn <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp+fn AS DOUBLE) END AS sensitivity,
  CASE WHEN tp+fp <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp+fp AS DOUBLE) END AS precision,
  CASE WHEN tn+fn <> 0 THEN CAST(tn AS DOUBLE) / CAST(tn+fn AS DOUBLE) END AS npv"""


def _scored(spark, sf_dir):
    return with_score(prepared(spark, sf_dir))


@register("confusion_at_half", PREPARED_SQL + """,
p AS (SELECT final, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS pred FROM scored),
c AS (SELECT CAST(count_if(pred=0 AND final=0) AS BIGINT) AS tn, CAST(count_if(pred=0 AND final=1) AS BIGINT) AS fn,
             CAST(count_if(pred=1 AND final=0) AS BIGINT) AS fp, CAST(count_if(pred=1 AND final=1) AS BIGINT) AS tp FROM p)
SELECT tn, fn, fp, tp, """ + _METRICS_SQL + " FROM c")
def q_confusion(spark, sf_dir):
    """A8 + A9: confusion counts and metrics at ``score > 0.5`` (G2's rule)."""
    s = _scored(spark, sf_dir).withColumn("pred", mt.classify("score", 0.5, strict=True))
    return mt.classification_report(s, "final", "pred")


@register("confusion_by_year", PREPARED_SQL + """,
p AS (SELECT year, final, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM scored),
c AS (SELECT year, CAST(count_if(pred=0 AND final=0) AS BIGINT) AS tn, CAST(count_if(pred=0 AND final=1) AS BIGINT) AS fn,
             CAST(count_if(pred=1 AND final=0) AS BIGINT) AS fp, CAST(count_if(pred=1 AND final=1) AS BIGINT) AS tp FROM p GROUP BY year)
SELECT year, tn, fn, fp, tp, """ + _METRICS_SQL + " FROM c")
def q_confusion_year(spark, sf_dir):
    """A8 + A9 per cohort (grouped)."""
    s = _scored(spark, sf_dir).withColumn("pred", mt.classify("score", 0.5))
    return mt.classification_report(s, "final", "pred", ["year"])


@register("regression_counts", PREPARED_SQL.replace(
    "CASE WHEN final >= 50 THEN 1 ELSE 0 END AS final", "final") + """,
p AS (SELECT final, 2 * h AS pred FROM scored),
c AS (SELECT CAST(count_if(final < 50 AND pred < 50) AS BIGINT) AS true_fail, CAST(count_if(final < 50 AND pred >= 50) AS BIGINT) AS false_pass,
             CAST(count_if(final >= 50 AND pred < 50) AS BIGINT) AS false_fail, CAST(count_if(final >= 50 AND pred >= 50) AS BIGINT) AS true_pass,
             round(avg(pow(final - pred, 2)), 6) AS mse FROM p)
SELECT true_fail, false_pass, false_fail, true_pass, mse,
  CAST(true_fail + true_pass AS DOUBLE) / CAST(true_fail + true_pass + false_pass + false_fail AS DOUBLE) AS accuracy,
  CASE WHEN true_fail + false_pass <> 0 THEN CAST(true_fail AS DOUBLE) / CAST(true_fail + false_pass AS DOUBLE) END AS specificity,
  CASE WHEN true_fail + false_fail <> 0 THEN CAST(true_fail AS DOUBLE) / CAST(true_fail + false_fail AS DOUBLE) END AS npv,
  CASE WHEN true_pass + false_fail <> 0 THEN CAST(true_pass AS DOUBLE) / CAST(true_pass + false_fail AS DOUBLE) END AS sensitivity
FROM c""")
def q_regression_counts(spark, sf_dir):
    """A10 + A11: a numeric prediction (2 * week mean) scored as pass/fail at 50."""
    s = with_score(prepared(spark, sf_dir, mark=None)).withColumn("pred", F.lit(2.0) * F.col("h"))
    return mt.regression_as_classifier(s, "final", "pred", 50.0).withColumn("mse", F.round("mse", 6))


@register("misclassification_cost", PREPARED_SQL + """
SELECT avg(CASE WHEN abs(final - score) > 0.5 THEN 1.0 ELSE 0.0 END) AS cost FROM scored
""")
def q_cost(spark, sf_dir):
    """``mean(abs(y - p) > 0.5)``."""
    return mt.misclassification_cost(_scored(spark, sf_dir), "final", "score")


_ROC_SQL = """,
u AS (SELECT {g}score, CAST(count_if(final = 1) AS BIGINT) AS pos, CAST(count_if(final = 0) AS BIGINT) AS neg FROM {src} GROUP BY {g}score),
tot AS (SELECT {g}CAST(sum(pos) AS BIGINT) AS P, CAST(sum(neg) AS BIGINT) AS N FROM u GROUP BY ALL),
c AS (SELECT {g}score, pos, neg,
        CAST(sum(pos) OVER w AS BIGINT) AS pos_cum, CAST(sum(neg) OVER w AS BIGINT) AS neg_cum,
        lead(score) OVER (PARTITION BY {gp} ORDER BY score) AS next_score
      FROM u WINDOW w AS (PARTITION BY {gp} ORDER BY score ROWS UNBOUNDED PRECEDING)),
d AS (SELECT {g}CASE WHEN median(score) FILTER (WHERE final = 0) > median(score) FILTER (WHERE final = 1)
             THEN '>' ELSE '<' END AS direction FROM {src} GROUP BY ALL),
r AS (
  SELECT {gc}CASE WHEN next_score IS NULL THEN CAST('inf' AS DOUBLE) ELSE (score + next_score) / 2 END AS threshold,
    d.direction, P, N,
    CASE WHEN d.direction = '<' THEN P - pos_cum ELSE pos_cum END AS tp,
    CASE WHEN d.direction = '<' THEN neg_cum ELSE N - neg_cum END AS tn
  FROM c JOIN d ON {jcd} JOIN tot ON {jct}
  UNION ALL
  SELECT {gd}CAST('-inf' AS DOUBLE), d.direction, P, N,
    CASE WHEN d.direction = '<' THEN P ELSE 0 END, CASE WHEN d.direction = '<' THEN 0 ELSE N END
  FROM d JOIN tot ON {jdt}),
roc AS (SELECT {g}threshold, direction, CAST(tp AS DOUBLE) / CAST(P AS DOUBLE) AS sensitivity,
          CAST(tn AS DOUBLE) / CAST(N AS DOUBLE) AS specificity,
          CAST(tp AS DOUBLE) / CAST(P AS DOUBLE) + CAST(tn AS DOUBLE) / CAST(N AS DOUBLE) - 1.0 AS youden,
          CAST(tp * N + tn * P - P * N AS BIGINT) AS youden_num FROM r)
"""


def roc_sql(src: str = "scored", group: str | None = None) -> str:
    if group:
        return _ROC_SQL.format(g=f"{group}, ", gp=group, src=src, gc=f"c.{group}, ", gd=f"d.{group}, ",
                               jcd=f"c.{group} = d.{group}", jct=f"c.{group} = tot.{group}",
                               jdt=f"d.{group} = tot.{group}")
    return _ROC_SQL.format(g="", gp="1", src=src, gc="", gd="", jcd="TRUE", jct="TRUE", jdt="TRUE")


@register("roc_curve", PREPARED_SQL + roc_sql() + "SELECT * FROM roc")
def q_roc(spark, sf_dir):
    """W1 + W3: exact ROC curve (all cut points) with Youden's J."""
    return mt.roc_curve(_scored(spark, sf_dir), "final", "score")


_AUC_SQL = """,
au AS (SELECT {g}score, CAST(count_if(final = 1) AS BIGINT) AS pos, CAST(count_if(final = 0) AS BIGINT) AS neg FROM {src} GROUP BY {g}score),
ac AS (SELECT {g}pos, neg, sum(neg) OVER (PARTITION BY {gp} ORDER BY score ROWS UNBOUNDED PRECEDING) AS neg_cum FROM au),
uu AS (SELECT {g}sum(pos * (neg_cum - neg * 0.5)) AS u, CAST(sum(pos) AS BIGINT) AS n_pos,
         CAST(sum(neg) AS BIGINT) AS n_neg FROM ac GROUP BY ALL),
ad AS (SELECT {g}CASE WHEN median(score) FILTER (WHERE final = 0) > median(score) FILTER (WHERE final = 1)
             THEN '>' ELSE '<' END AS direction FROM {src} GROUP BY ALL),
aucs AS (SELECT {gu}CASE WHEN direction = '<' THEN u / (CAST(n_pos AS DOUBLE) * CAST(n_neg AS DOUBLE))
             ELSE 1.0 - u / (CAST(n_pos AS DOUBLE) * CAST(n_neg AS DOUBLE)) END AS auc, direction, n_pos, n_neg
         FROM uu JOIN ad ON {j})
"""


def auc_sql(src: str = "scored", group: str | None = None) -> str:
    if group:
        return _AUC_SQL.format(g=f"{group}, ", gp=group, src=src, gu=f"uu.{group}, ", j=f"uu.{group} = ad.{group}")
    return _AUC_SQL.format(g="", gp="1", src=src, gu="", j="TRUE")


@register("auc_score", PREPARED_SQL + auc_sql() + "SELECT * FROM aucs")
def q_auc(spark, sf_dir):
    """Exact AUC of the score."""
    return mt.auc(_scored(spark, sf_dir), "final", "score")


@register("auc_by_year", PREPARED_SQL + auc_sql(group="year") + "SELECT * FROM aucs")
def q_auc_year(spark, sf_dir):
    """W2 per cohort."""
    return mt.auc(_scored(spark, sf_dir), "final", "score", ["year"])


_BEST_SQL = """,
best AS (SELECT threshold, youden, sensitivity, specificity FROM roc
         ORDER BY youden_num DESC, CASE WHEN direction = '<' THEN threshold ELSE -threshold END LIMIT 1)
"""


@register("best_threshold", PREPARED_SQL + roc_sql() + _BEST_SQL + "SELECT * FROM best")
def q_best(spark, sf_dir):
    """Threshold at the first maximum of Youden's J."""
    return mt.best_threshold(mt.roc_curve(_scored(spark, sf_dir), "final", "score"))


@register("threshold_sweep", PREPARED_SQL + """,
g AS (SELECT CAST(range AS DOUBLE) / CAST(100 AS DOUBLE) AS threshold FROM range(0, 101)),
c AS (SELECT threshold, CAST(count_if(score < threshold AND final = 0) AS BIGINT) AS tn, CAST(count_if(score < threshold AND final = 1) AS BIGINT) AS fn,
             CAST(count_if(score >= threshold AND final = 0) AS BIGINT) AS fp, CAST(count_if(score >= threshold AND final = 1) AS BIGINT) AS tp
      FROM g, scored GROUP BY threshold)
SELECT threshold, tn, fn, fp, tp, """ + _METRICS_SQL.replace(
    "  1.0 - CASE WHEN (tn+fn+fp+tp) <> 0 THEN CAST(tn+tp AS DOUBLE) / CAST(tn+fn+fp+tp AS DOUBLE) END AS misclassification,\n", "") + """,
  CASE WHEN tp+fn <> 0 AND tn+fp <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp+fn AS DOUBLE) + CAST(tn AS DOUBLE) / CAST(tn+fp AS DOUBLE) - 1.0 END AS youden
FROM c""")
def q_sweep(spark, sf_dir):
    """accuracy/sensitivity/specificity/precision/NPV/Youden at t = 0, .01, ..., 1."""
    return mt.threshold_sweep(_scored(spark, sf_dir), "final", "score")


_SPLIT_SQL = """,
sr AS (SELECT *, row_number() OVER (ORDER BY md5(concat('46:', CAST(id AS VARCHAR)))) AS rk, count(*) OVER () AS n FROM scored),
split AS (SELECT * EXCLUDE (rk, n), CASE WHEN rk <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS split FROM sr),
train AS (SELECT * FROM split WHERE split = 'train'),
test AS (SELECT * FROM split WHERE split = 'test')
"""


@register("threshold_table", PREPARED_SQL + _SPLIT_SQL + roc_sql("train") + _BEST_SQL + """,
ts AS (SELECT 'base' AS rule, CAST(0.5 AS DOUBLE) AS threshold, 1 AS o UNION ALL SELECT 'halfway', (threshold + CAST(0.5 AS DOUBLE)) / 2, 2 FROM best
       UNION ALL SELECT 'best', threshold, 3 FROM best),
tc AS (SELECT rule, ts.threshold,
        CAST(count_if(score < ts.threshold AND final = 0) AS BIGINT) AS tn, CAST(count_if(score < ts.threshold AND final = 1) AS BIGINT) AS fn,
        CAST(count_if(score >= ts.threshold AND final = 0) AS BIGINT) AS fp, CAST(count_if(score >= ts.threshold AND final = 1) AS BIGINT) AS tp
      FROM ts, test GROUP BY rule, ts.threshold),
m AS (SELECT rule, threshold, fn, fp, """ + _METRICS_SQL + """ FROM tc)
SELECT rule, threshold, (sensitivity + specificity) / 2 AS auc, accuracy, specificity, npv, sensitivity,
       fn AS false_fails, fp AS false_passes FROM m
""")
def q_table(spark, sf_dir):
    """Best threshold from the training ROC, then the three-threshold table
    (0.5, halfway, best) on the held-out rows."""
    s = sm.split_train_test(_scored(spark, sf_dir), "id", 0.8, 46)
    train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    best = mt.best_threshold(mt.roc_curve(train, "final", "score")).first()["threshold"]
    return mt.threshold_table(test, best, "final", "score")


@register("threshold_sweep_rounded", PREPARED_SQL + """,
g AS (SELECT CAST(range AS DOUBLE) / CAST(100 AS DOUBLE) AS threshold FROM range(0, 101)),
c AS (SELECT threshold, avg(CASE WHEN (score >= threshold) = (final = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM g, scored GROUP BY threshold)
SELECT threshold, round_even(accuracy, 2) AS accuracy FROM c
""")
def q_sweep_rounded(spark, sf_dir):
    """2.12 ``round(x, 2)``, half to even, on the sweep's accuracies."""
    return mt.threshold_sweep(_scored(spark, sf_dir), "final", "score").select("threshold", round_half_even("accuracy", 2).alias("accuracy"))
