"""Sampling and ordered-primitive invariants (exact sizes, disjointness,
balance, two-level ranks equal a plain sort, exact quantiles)."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import ranking as rk
from cohortlens.operators import sampling as sm


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(0, 2003).withColumn("final", (F.col("id") % 7 < 3).cast("int"))


def test_split_exact_and_disjoint(ids):
    s = sm.split_train_test(ids, "id", 0.8, 46)
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts["train"] == math.floor(0.8 * 2003)
    assert counts["train"] + counts["test"] == 2003
    assert s.select("id").distinct().count() == 2003


def test_split_membership_is_md5_order(ids):
    s = sm.split_train_test(ids, "id", 0.8, 46)
    keys = sorted(range(2003), key=lambda i: hashlib.md5(f"46:{i}".encode()).hexdigest())
    want = set(keys[: math.floor(0.8 * 2003)])
    got = {r["id"] for r in s.where("split = 'train'").select("id").collect()}
    assert got == want


def test_folds_balanced(ids):
    f = sm.assign_folds(ids, 10)
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 1


def test_downsample_sizes(ids):
    d = sm.downsample_majority(ids, "final", "id", minority=1, seed=1)
    c = {r["final"]: r["count"] for r in d.groupBy("final").count().collect()}
    n1 = ids.where("final = 1").count()
    assert c[1] == n1 and c[0] == n1


def test_split_then_balance_test_untouched(ids):
    s = sm.split_then_balance_train(ids, "final", "id", minority=1)
    full = sm.split_train_test(ids, "id", 0.8, 46)
    assert s.where("split = 'test'").count() == full.where("split = 'test'").count()


def test_hash_rank_small_buckets_matches_sort(spark):
    df = spark.range(0, 500).withColumn("k", F.md5(F.col("id").cast("string")))
    r = rk.hash_rank(df, "k", digits=1).select("id", "rank").collect()
    got = {x["id"]: x["rank"] for x in r}
    order = sorted(range(500), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert all(got[i] == j + 1 for j, i in enumerate(order))


def test_order_statistics_multi_pass(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=3000), np.full(1000, 0.25), [-0.0, 0.0, 1e300, -1e300, np.inf, -np.inf, 5e-324, np.nan]])  # a heavy duplicate
    df = spark.createDataFrame([(float(v), float(i % 7), None if i % 3 else 1.5) for i, v in enumerate(vals)], "x double, y double, z double")
    s = np.sort(vals[~np.isnan(vals)])
    ranks = [0, 1, 2, 17, 1500, 2000, 2500, 3999, 4003, len(s) - 1]
    got = rk.order_statistics_many(df, {"x": ranks, "y": [0, 1000, 4000], "z": [0, 5]})
    assert all(got["x"][r] == s[r] for r in ranks)
    y = sorted(float(i % 7) for i in range(len(vals)))
    assert got["y"] == {r: y[r] for r in (0, 1000, 4000)} and got["z"] == {0: 1.5, 5: 1.5}
    with pytest.raises(ValueError):
        rk.order_statistics(df, "x", [len(s)])


def test_radix_selection_of_many_columns_in_parts(spark, monkeypatch):
    monkeypatch.setattr(rk, "MOST_SLOTS", 3)
    rng = np.random.default_rng(4)
    cols = {f"c{i}": np.round(rng.normal(size=500) * 10.0 ** i, 3) for i in range(-3, 4)}
    df = spark.createDataFrame([tuple(float(v[j]) for v in cols.values()) for j in range(500)], list(cols))
    got = rk.quantiles_type7_many(df, {c: [0, 0.25, 0.5, 0.75, 1] for c in cols}, dict.fromkeys(cols, 500))
    for c, v in cols.items():
        assert np.allclose(got[c], np.quantile(v, [0, 0.25, 0.5, 0.75, 1]), rtol=1e-14, atol=0)


def test_quantiles_type7(spark):
    rng = np.random.default_rng(5)
    vals = rng.exponential(size=777)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    probs = [0, 0.1, 0.25, 0.5, 0.9, 1]
    got = rk.quantiles_type7(df, "x", probs)
    assert np.allclose(got, np.quantile(vals, probs), rtol=0, atol=1e-12)


def test_running_sums_match_pandas(spark):
    rng = np.random.default_rng(7)
    vals = rng.permutation(400)
    df = spark.createDataFrame([(int(v) % 3 if v % 5 else None, float(v), int(v % 3)) for v in vals], "g long, v double, w long")
    out = rk.running_sums(df, "v", ["w"], ["g"], with_next="next", n=16).toPandas().sort_values("v")
    for g, part in out.groupby("g", dropna=False):
        assert (part["w"].cumsum() == part["w_cum"]).all() and (part["w_tot"] == part["w"].sum()).all()
        assert part["next"].iloc[:-1].tolist() == part["v"].iloc[1:].tolist() and np.isnan(part["next"].iloc[-1])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_splits_move_no_rows(spark, ids, tmp_path):
    """Cut keys instead of ranks: the plans are filters and projections of the scan."""
    ids.write.parquet(str(tmp_path / "ids"))
    df = spark.read.parquet(str(tmp_path / "ids"))
    for out in (sm.split_train_test(df), sm.downsample_majority(df, minority=1), sm.balanced_then_split(df, minority=1), sm.split_then_balance_train(df, minority=1)):
        plan = plan_of(out)
        assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


def test_cut_keys_equal_ranks_with_ties_and_missing_ids(spark):
    rows = [(i % 40 if i % 3 else 7, i % 2) for i in range(3000)] + [(None, 1)] * 500
    df = spark.createDataFrame(rows, "id long, final int")
    s = sm.split_train_test(df, frac=0.37)
    assert {r["split"]: r["count"] for r in s.groupBy("split").count().collect()} == {"train": math.floor(0.37 * 3500), "test": 3500 - math.floor(0.37 * 3500)}
    key = lambda i: hashlib.md5(b"" if i is None else f"46:{i}".encode()).hexdigest()
    order = sorted(key(i) for i, _ in rows)
    cut = order[math.floor(0.37 * 3500) - 1]
    for r in s.distinct().collect():
        assert key(r["id"]) == cut or (r["split"] == "train") == (key(r["id"]) < cut)
    few = sm.downsample_majority(df, minority=None)
    assert {r["final"]: r["count"] for r in few.groupBy("final").count().collect()} == {0: 1500, 1: 1500}
    none = sm.downsample_majority(df, minority=5)
    assert none.count() == 0
    flagged = sm.downsample_majority(df.withColumn("in", (F.col("id") < 20).cast("int")), minority=None, flag="kept", within="in")
    assert flagged.count() == 3500 and flagged.where("kept = 1 and coalesce(`in`, 0) = 0").count() == 0


@pytest.mark.parametrize("frac", [0.0, 1.0])
def test_split_takes_nothing_or_everything(ids, frac):
    assert sm.split_train_test(ids, frac=frac).where("split = 'train'").count() == 2003 * frac
    assert sm.split_train_test(ids.limit(0), frac=frac).count() == 0


def test_design_folds_balanced_per_training_set(spark):
    from cohortlens.plans.chronological import Scenario, build_design
    df = (spark.range(0, 997).withColumn("f", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
          .withColumn("x", F.col("id") * 0.5).withColumn("final", (F.col("id") % 3 == 0).cast("int"))
          .withColumn("t1", (F.col("id") % 5 != 0).cast("int")).withColumn("t2", (F.col("id") < 400).cast("int")))
    scen = [Scenario("s1", "t1", "t2"), Scenario("s2", "t2", "t1"), Scenario("s3", "t1", "t1")]
    des = build_design(df, ["f"], ["x"], "final", scen, k=10)
    for s in scen:
        sizes = [r["count"] for r in des.df.where(f"{s.train} = 1").groupBy(f"fold_{s.name}").count().collect()]
        assert len(sizes) == 10 and max(sizes) - min(sizes) <= 1
        assert des.df.where(f"{s.train} = 0 AND fold_{s.name} IS NOT NULL").count() == 0


def test_positions_equal_a_plain_sort_and_split_a_hot_key(spark):
    df = spark.range(5000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 > 1, F.col("id") % 97))
    ranged = rk.in_ranges(df, ["k"], 16)
    sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 5000 / 16  # a third of the rows has one key
    got = sorted(rk.positions(df, ["k", -F.col("id")], total="n").collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(5000)) and {r.n for r in got} == {5000}
    want = sorted(df.collect(), key=lambda r: (r.k is not None, r.k or 0, -r.id))
    assert [r.id for r in got] == [r.id for r in want]
    assert rk.positions(df.limit(0), ["k"]).collect() == []
    sums = rk.range_offsets(ranged, ["id"]).orderBy("_range").collect()
    assert [r.id_total for r in sums] == [5000 * 4999 // 2] * 16 and sums[0].id_before == 0
