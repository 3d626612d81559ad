"""Diagnostics against numpy, R's pretty(), sources/sinks round trips, edge rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import diagnostics as dg
from cohortlens.operators import events as ev
from cohortlens.operators import prepare as pr
from cohortlens.operators import profile as pf
from cohortlens.sources import readers as rd
from cohortlens.sources import sinks


def test_acf_matches_numpy_with_halo(spark):
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(size=700)) * 0.1 + rng.normal(size=700)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, r double")
    got = dg.acf(df, "r", "id", block=64).orderBy("lag").toPandas()["acf"].to_numpy()
    c = x - x.mean()
    L = int(math.floor(10 * math.log10(len(x))))
    want = np.array([np.sum(c[k:] * c[:len(c) - k]) for k in range(L + 1)]) / np.sum(c * c)
    assert np.allclose(got, want, atol=1e-12)


def test_qnorm():
    from statistics import NormalDist
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    ps = [0.001, 0.01, 0.2, 0.5, 0.77, 0.99, 0.9999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(dg.qnorm(F.col("p"))).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(p) for p in ps], atol=1e-8)


def test_pretty_known_values():
    assert pf.pretty(0, 97, 8, min_n=1) == [0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100]
    assert pf.pretty(-1.3, 2.7, 5, min_n=1) == pytest.approx([-2, -1, 0, 1, 2, 3])
    assert pf.pretty(0.012, 0.087, 6, min_n=1) == pytest.approx([0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09])


def test_histogram_density_integrates_to_one(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(size=999)], "x double")
    h = pf.density_histogram(df, "x").toPandas()
    assert h["count"].sum() == 999
    assert (h["density"] * (h["upper"] - h["lower"])).sum() == pytest.approx(1.0)


def test_jarque_bera_normal_sample(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(size=4000)], "x double")
    assert dg.jarque_bera(df, "x").first()["p_value"] > 0.01


def test_activity_log_round_trip(spark, tmp_path):
    rows = [("2015-03-01 10:00:00", "content.read", "r1", "u1", "s1", "student", "1"),
            ("2015-03-01 10:05:00", "content.read", "r2", "u2", "s1", "student", "1"),
            ("2015-03-02 09:00:00", "site.visit", "r3", "u1", "s2", "student", "1")]
    p = tmp_path / "log2015"
    p.mkdir()
    (p / "part.csv").write_text("\n".join(",".join(r) for r in rows) + "\n")
    d = tmp_path / "types.csv"
    d.write_text("EVENT_ID,DESCRIPTION\ncontent.read,Read content\nsite.visit,Visit site\n")
    log = rd.read_by_year(spark, {2015: str(p), 2016: str(p)})
    assert log.columns[:7] == rd.ACTIVITY_LOG_COLUMNS and log.count() == 6
    types = rd.read_dimension(spark, str(d), key="event_id")
    assert types.columns == ["event_id", "description"]
    top = ev.top_events_described(log.where("year = 2015"), types, 50)
    lines = sinks.description_lines(top, fallback_col="event_id").orderBy(F.desc("n")).collect()
    assert [r["line"] for r in lines] == ["Read content 2", "Visit site 1"]
    out = tmp_path / "lines"
    sinks.write_lines(sinks.description_lines(top, fallback_col="event_id"), str(out))
    assert spark.read.text(str(out)).count() == 2


def test_unmatched_key_keeps_null_description(spark):
    log = spark.createDataFrame([("a",), ("a",), ("b",)], "event_id string")
    types = spark.createDataFrame([("a", "Alpha")], "event_id string, description string")
    r = {x["event_id"]: x["description"] for x in ev.top_events_described(log, types).collect()}
    assert r == {"a": "Alpha", "b": None}


def test_sanitize_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`NBT.AL Score` int, `Maths..High.school.` int, `2nd` int")
    assert rd.sanitize_columns(df).columns == ["nbt_al_score", "maths_high_school", "x2nd"]


def test_edge_rows_tolerant_cast_and_all_null(spark):
    df = spark.createDataFrame([("1.5", None, "x"), ("abc", None, "y"), (None, None, "z")],
                               "mark string, empty double, f string")
    out = pr.to_double(df, ["mark"]).collect()
    assert [r["mark"] for r in out] == [1.5, None, None]
    prof = {r["column"]: r["n_null"] for r in pf.null_profile(df).collect()}
    assert prof == {"mark": 1, "empty": 3, "f": 0}
    assert pr.complete_cases(pr.to_double(df, ["mark"]), ["mark"]).count() == 1


def test_activity_log_from_events_table(spark, tmp_path):
    """S1 + S2 + S4 on the driver's events table written as headerless CSV logs."""
    ev_tbl = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    log_cols = ev_tbl.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_date"),
                             F.col("event_type").alias("event_id"), F.col("event_id").cast("string").alias("ref"),
                             F.col("user_id").cast("string").alias("user_id"), F.lit("site").alias("site_id"),
                             F.lit("student").alias("role_id"), F.lit("1").alias("is_student"))
    a, b = tmp_path / "a", tmp_path / "b"
    log_cols.where("ref % 2 = 0").write.option("header", "false").csv(str(a))
    log_cols.where("ref % 2 = 1").write.option("header", "false").csv(str(b))
    types = tmp_path / "types"
    ev_tbl.select(F.col("event_type").alias("EVENT_ID")).distinct() \
        .withColumn("DESCRIPTION", F.concat(F.lit("type "), "EVENT_ID")).coalesce(1) \
        .write.option("header", "true").csv(str(types))
    log = rd.read_by_year(spark, {2015: str(a), 2016: str(b)})
    assert log.count() == ev_tbl.count()
    assert log.where("event_date IS NULL").count() == 0
    want = {r["event_type"]: r["count"] for r in ev_tbl.groupBy("event_type").count().collect()}
    got = {r["event_id"]: r["n"] for r in ev.event_frequency(log, "event_id").collect()}
    assert got == want
    dim = rd.read_dimension(spark, str(types), key="event_id")
    top = ev.top_events_described(log, dim, 50)
    assert top.where("description IS NULL").count() == 0
    per_year = log.groupBy("year").count().collect()
    assert sum(r["count"] for r in per_year) == ev_tbl.count() and len(per_year) == 2


def test_size_for_input(spark):
    from cohortlens.session import size_for_input
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        n = size_for_input(spark, 10 * (128 << 20), overwrite=True)
        assert n == max(spark.sparkContext.defaultParallelism, 10)
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == str(128 << 20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_qq_points_match_ppoints(spark):
    from statistics import NormalDist
    rng = np.random.default_rng(12)
    x = rng.standard_t(5, size=333)
    df = spark.createDataFrame([(float(v),) for v in x], "r double")
    got = dg.qq_points(df, "r").orderBy("i").toPandas()
    n = len(x)
    pp = (np.arange(1, n + 1) - 0.5) / n
    assert np.allclose(got["sample"], np.sort(x))
    assert np.allclose(got["theoretical"], [NormalDist().inv_cdf(p) for p in pp], atol=1e-8)


def test_union_cohorts_equals_in_filter(spark):
    df = spark.createDataFrame([(i, 2015 + i % 3) for i in range(30)], "id long, year long")
    u = pr.union_cohorts(pr.cohort(df, 2015), pr.cohort(df, 2016))
    f = pr.cohort(df, [2015, 2016])
    assert sorted(u.collect()) == sorted(f.collect())
