"""Registered queries: cohort preparation, profiles and sampling."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import functions as F

from cohortlens.operators import prepare as pr
from cohortlens.operators import profile as pf
from cohortlens.operators import sampling as sm
from cohortlens.plans.common import (NUMERIC_PREPARED_SQL, PREPARED_SQL, WEEKS, cached, prepared)
from cohortlens.plans.registry import register
from cohortlens.session import ensure_checkpoint_dir
from cohortlens.sources.readers import read_cohorts
from cohortlens.sources.sinks import write_cohorts
from cohortlens.sources.tables import STUDENT_WIDE_SQL, student_wide

_W = ", ".join(WEEKS)
SPARSE = ["w9", "w10", "w11", "w12"]


@register("student_wide", STUDENT_WIDE_SQL + "SELECT * FROM student_wide")
def q_student_wide(spark, sf_dir):
    """The one-row-per-person table."""
    return student_wide(spark, sf_dir)


@register("prepared_cohort", PREPARED_SQL + f"SELECT id, year, segment, region, acctbal, {_W}, final FROM prepared")
def q_prepared(spark, sf_dir):
    """P1 + P2 + P3 + P4 + P6: zero fill, casts, pass label at 50, complete cases."""
    return prepared(spark, sf_dir)


@register("prepared_mark55_counts", STUDENT_WIDE_SQL + """
SELECT CASE WHEN final >= 55 THEN 1 ELSE 0 END AS final, count(*) AS n FROM student_wide
WHERE final IS NOT NULL AND acctbal IS NOT NULL GROUP BY 1
""")
def q_mark55(spark, sf_dir):
    """P6 at pass mark 55 + A5."""
    return pf.class_counts(prepared(spark, sf_dir, mark=55.0))


@register("sparse_dropped_count", STUDENT_WIDE_SQL + """
SELECT count(*) AS n_fill_then_drop,
       count(*) FILTER (WHERE w1 IS NOT NULL AND w2 IS NOT NULL AND w3 IS NOT NULL AND w4 IS NOT NULL
         AND w5 IS NOT NULL AND w6 IS NOT NULL AND w7 IS NOT NULL AND w8 IS NOT NULL) AS n_drop_only
FROM student_wide WHERE final IS NOT NULL AND acctbal IS NOT NULL
""")
def q_sparse(spark, sf_dir):
    """P5: drop the sparse (late-week) columns, then complete cases; both the
    reference's zero-fill-first order and the drop-only variant."""
    sw = student_wide(spark, sf_dir)
    a = pr.prepare_student(sw, WEEKS, ["acctbal"], ["segment", "region"], "final", 50.0,
                           sparse=SPARSE, variant="fill_then_drop")
    b = pr.prepare_student(sw, WEEKS, ["acctbal"], ["segment", "region"], "final", 50.0,
                           sparse=SPARSE, variant="drop_only")
    na = a.groupBy(F.lit(1).alias("_k")).agg(F.count(F.lit(1)).alias("n_fill_then_drop"))
    nb = b.groupBy(F.lit(1).alias("_k")).agg(F.count(F.lit(1)).alias("n_drop_only"))
    return na.join(nb, "_k").drop("_k")


def cohort_store(spark, sf_dir):
    """The prepared table in shared storage, by year; written once for a state of the input files."""
    def build():
        source = prepared(spark, sf_dir)
        path = posixpath.join(ensure_checkpoint_dir(spark), f"cohorts-{uuid.uuid4().hex}")
        write_cohorts(source, path)
        return read_cohorts(spark, path, source.schema)
    return cached(spark, sf_dir, "cohorts", build)


@register("cohort_2016", PREPARED_SQL + f"SELECT id, segment, region, acctbal, {_W}, final FROM prepared WHERE year = 2016")
def q_cohort(spark, sf_dir):
    """P7 + P8: one cohort, read from the folder of its year; year removed as a predictor."""
    return pr.drop_predictors(pr.cohort(cohort_store(spark, sf_dir), 2016), "year")


@register("cohorts_2015_2016", PREPARED_SQL + f"SELECT id, year, final FROM prepared WHERE year IN (2015, 2016)")
def q_union(spark, sf_dir):
    """U1 + S4: the row union of two cohorts, expressed as one IN filter on the
    stored cohorts (two of the years' folders are read)."""
    return pr.cohort(cohort_store(spark, sf_dir), [2015, 2016]).select("id", "year", "final")


@register("fail_rows", PREPARED_SQL + "SELECT id, year, final FROM prepared WHERE final = 0")
def q_fail(spark, sf_dir):
    """The class-0 (fail) rows."""
    return pr.class_rows(prepared(spark, sf_dir), "final", 0).select("id", "year", "final")


@register("predicate_counts", PREPARED_SQL + """
SELECT CAST(count_if(segment = 'BUILDING') AS BIGINT) AS building,
       CAST(count_if(segment = 'AUTOMOBILE' AND region = 'ASIA') AS BIGINT) AS automobile_asia,
       CAST(count_if(segment = 'MACHINERY' AND region = 'EUROPE') AS BIGINT) AS machinery_europe,
       CAST(count_if(region = 'AFRICA' AND final = 1) AS BIGINT) AS africa_pass,
       CAST(count_if(region = 'AMERICA') AS BIGINT) AS america
FROM prepared
""")
def q_predicates(spark, sf_dir):
    """P10: several multi-predicate counts in one pass."""
    c = F.col
    return pr.count_where(prepared(spark, sf_dir), {
        "building": c("segment") == "BUILDING",
        "automobile_asia": (c("segment") == "AUTOMOBILE") & (c("region") == "ASIA"),
        "machinery_europe": (c("segment") == "MACHINERY") & (c("region") == "EUROPE"),
        "africa_pass": (c("region") == "AFRICA") & (c("final") == 1),
        "america": c("region") == "AMERICA",
    })


@register("category_shares", PREPARED_SQL + """
SELECT avg(CASE WHEN region = 'EUROPE' THEN 1.0 ELSE 0.0 END) AS europe,
       avg(CASE WHEN segment = 'HOUSEHOLD' THEN 1.0 ELSE 0.0 END) AS household
FROM prepared
""")
def q_shares(spark, sf_dir):
    """Category shares."""
    return pr.share_where(prepared(spark, sf_dir), {"europe": F.col("region") == "EUROPE",
                                                    "household": F.col("segment") == "HOUSEHOLD"})


@register("null_profile", STUDENT_WIDE_SQL + """
SELECT "column", n_null FROM (
  UNPIVOT (SELECT """ + ", ".join(f"CAST(count_if({c} IS NULL) AS BIGINT) AS {c}" for c in
                                 ["id", "year", "segment", "region", "acctbal", *WEEKS, "final"]) + """
           FROM student_wide)
  ON COLUMNS(*) INTO NAME "column" VALUE n_null)
WHERE n_null > 700
""")
def q_null_profile(spark, sf_dir):
    """A4: columns with more than 700 NULLs."""
    return pf.null_profile(student_wide(spark, sf_dir), min_nulls=700)


@register("class_counts", PREPARED_SQL + "SELECT final, count(*) AS n FROM prepared GROUP BY final")
def q_class_counts(spark, sf_dir):
    """A5."""
    return pf.class_counts(prepared(spark, sf_dir))


_NUMS = ["acctbal", *WEEKS]


@register("corr_with_final", NUMERIC_PREPARED_SQL + """
SELECT "column", r FROM (UNPIVOT (SELECT """ + ", ".join(f"round(corr({c}, final), 9) AS {c}" for c in _NUMS) + """
  FROM prepared_num) ON COLUMNS(*) INTO NAME "column" VALUE r)
""")
def q_corr_final(spark, sf_dir):
    """Correlation of every numeric predictor with the (numeric) final."""
    return pf.correlation_with(prepared(spark, sf_dir, mark=None), _NUMS, "final")


_CM = ["acctbal", "w1", "w2", "w3", "w4", "final"]


@register("corr_matrix", NUMERIC_PREPARED_SQL + " UNION ALL ".join(
    [f"SELECT '{a}' AS a, '{b}' AS b, " + ("CAST(1.0 AS DOUBLE) AS r" if a == b else
                                         f"round(corr({a}, {b}), 9) AS r FROM prepared_num")
     for a in _CM for b in _CM]))
def q_corr_matrix(spark, sf_dir):
    """Listwise-complete correlation matrix, long form."""
    return pf.correlation_matrix(prepared(spark, sf_dir, mark=None), _CM)


_SUM = ["acctbal", "w1", "w6", "final"]


@register("numeric_summary", NUMERIC_PREPARED_SQL + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", min({c}) AS min, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median,
        round(avg({c}), 9) AS mean, quantile_cont({c}, 0.75) AS q3, max({c}) AS max, CAST(count_if({c} IS NULL) AS BIGINT) AS n_null
        FROM prepared_num""" for c in _SUM))
def q_summary(spark, sf_dir):
    """A13 (numeric): six-number summary with exact type-7 quartiles."""
    out = pf.numeric_summary(prepared(spark, sf_dir, mark=None), _SUM)
    return out.withColumn("mean", F.round("mean", 9))


@register("level_counts", PREPARED_SQL + """
SELECT 'segment' AS "column", segment AS level, count(*) AS n FROM prepared GROUP BY segment
UNION ALL SELECT 'region', region, count(*) FROM prepared GROUP BY region
""")
def q_levels(spark, sf_dir):
    """A13 (factors): level counts."""
    return pf.level_counts(prepared(spark, sf_dir), ["segment", "region"])


@register("mean_sd", NUMERIC_PREPARED_SQL + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(avg({c}), 9) AS mean, round(stddev_samp({c}), 9) AS sd FROM prepared_num"""
    for c in _SUM))
def q_mean_sd(spark, sf_dir):
    """A14."""
    out = pf.mean_sd(prepared(spark, sf_dir, mark=None), _SUM)
    return out.withColumns({"mean": F.round("mean", 9), "sd": F.round("sd", 9)})


@register("regression_lines", NUMERIC_PREPARED_SQL + " UNION ALL ".join(
    f"SELECT '{x}' AS x, round(regr_slope(final, {x}), 9) AS slope, round(regr_intercept(final, {x}), 9) AS intercept "
    f"FROM prepared_num" for x in ["acctbal", "w1", "w5"]))
def q_lines(spark, sf_dir):
    """Simple-regression overlay lines of final on three predictors."""
    out = pf.simple_regression_line(prepared(spark, sf_dir, mark=None), "final", ["acctbal", "w1", "w5"])
    return out.withColumns({"slope": F.round("slope", 9), "intercept": F.round("intercept", 9)})


# ------------------------------------------------------------------ sampling

_RANK = "row_number() OVER (ORDER BY md5(concat('{seed}:', CAST(id AS VARCHAR))))"


@register("split_80_20", PREPARED_SQL + """,
r AS (SELECT id, """ + _RANK.format(seed=46) + """ AS rk, count(*) OVER () AS n FROM prepared)
SELECT id, CASE WHEN rk <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS split FROM r
""")
def q_split(spark, sf_dir):
    """M1 + J2: exact-size 80/20 split by md5 rank (seed 46)."""
    return sm.split_train_test(prepared(spark, sf_dir), "id", 0.8, 46).select("id", "split")


_DOWN = """,
cnt AS (SELECT count(*) FILTER (WHERE final = 0) AS m FROM {src}),
rk AS (SELECT *, row_number() OVER (PARTITION BY final ORDER BY md5(concat('{seed}:', CAST(id AS VARCHAR)))) AS r FROM {src}),
down AS (SELECT rk.* EXCLUDE (r) FROM rk, cnt WHERE rk.final = 0 OR rk.r <= cnt.m)
"""


#: At this mark the fails (class 0) are a clear minority of the test tables' cohort.
_LOW_MARK = 46.0
_LOW_SQL = PREPARED_SQL.replace("final >= 50", "final >= 46")


@register("downsample_balanced", _LOW_SQL + _DOWN.format(src="prepared", seed=1) + "SELECT id, final FROM down")
def q_down(spark, sf_dir):
    """M2 + U2: every fail row plus as many pass rows (md5 rank, seed 1), pass mark 46."""
    return sm.downsample_majority(prepared(spark, sf_dir, _LOW_MARK), "final", "id", 0, 1).select("id", "final")


@register("downsample_smaller_class", PREPARED_SQL + """,
cnt AS (SELECT final AS small, count(*) AS m FROM prepared GROUP BY final ORDER BY m, final LIMIT 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY final ORDER BY md5(concat('1:', CAST(id AS VARCHAR)))) AS r FROM prepared)
SELECT id, final FROM rk, cnt WHERE final = small OR r <= m""")
def q_down_smaller(spark, sf_dir):
    """M2 + U2: the smaller class, whichever it is, plus as many rows of the other."""
    return sm.downsample_majority(prepared(spark, sf_dir), "final", "id", None, 1).select("id", "final")


@register("balanced_then_split", _LOW_SQL + _DOWN.format(src="prepared", seed=1) + """,
r2 AS (SELECT id, final, row_number() OVER (ORDER BY md5(concat('2:', CAST(id AS VARCHAR)))) AS rk,
       count(*) OVER () AS n FROM down)
SELECT id, final, CASE WHEN rk <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS split FROM r2
""")
def q_bal_split(spark, sf_dir):
    """M3: down-sample, then split (balanced test set), pass mark 46."""
    return sm.balanced_then_split(prepared(spark, sf_dir, _LOW_MARK), "final", "id", 0, 0.8, 1, 2).select("id", "final", "split")


@register("split_then_balance", PREPARED_SQL + """,
r AS (SELECT *, """ + _RANK.format(seed=46) + """ AS rk, count(*) OVER () AS n FROM prepared),
s AS (SELECT * EXCLUDE (rk, n), CASE WHEN rk <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS split FROM r),
tr AS (SELECT * FROM s WHERE split = 'train')""" + _DOWN.format(src="tr", seed=1) + """
SELECT id, final, split FROM down UNION ALL SELECT id, final, split FROM s WHERE split = 'test'
""")
def q_split_bal(spark, sf_dir):
    """M4: split, then down-sample the training rows only."""
    return sm.split_then_balance_train(prepared(spark, sf_dir), "final", "id", 0, 0.8, 46, 1).select(
        "id", "final", "split")


@register("folds_10", PREPARED_SQL + """
SELECT id, CAST((row_number() OVER (ORDER BY md5(concat('1:', CAST(id AS VARCHAR)))) - 1) % 10 AS INTEGER) AS fold
FROM prepared
""")
def q_folds(spark, sf_dir):
    """M5: balanced 10-fold assignment."""
    return sm.assign_folds(prepared(spark, sf_dir), 10, "id", 1).select("id", "fold")
