"""Evaluation operators against brute force on small fixtures."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import metrics as mt


def _frame(spark, ys, ss):
    return spark.createDataFrame([(int(y), float(s)) for y, s in zip(ys, ss)], "final int, score double")


def brute_auc(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y == 0]
    u = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    a = u / (len(pos) * len(neg))
    return a if np.median(neg) <= np.median(pos) else 1 - a


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_auc_matches_pairwise(spark, seed):
    rng = np.random.default_rng(seed)
    ys = rng.integers(0, 2, 300)
    ss = np.round(rng.normal(ys * 0.7, 1.0), 1)  # many ties
    got = mt.auc(_frame(spark, ys, ss)).first()["auc"]
    assert got == pytest.approx(brute_auc(ys, ss), abs=1e-12)


def test_auc_invariant_under_monotone_transform(spark):
    rng = np.random.default_rng(9)
    ys = rng.integers(0, 2, 200)
    ss = rng.normal(ys, 1.0)
    a = mt.auc(_frame(spark, ys, ss)).first()["auc"]
    b = mt.auc(_frame(spark, ys, np.exp(ss) * 3 + 1)).first()["auc"]
    assert 0 <= a <= 1 and a == pytest.approx(b, abs=1e-12)


def test_auc_direction_reversed(spark):
    ys = [0, 0, 0, 1, 1, 1]
    ss = [0.9, 0.8, 0.7, 0.1, 0.2, 0.3]
    r = mt.auc(_frame(spark, ys, ss)).first()
    assert r["direction"] == ">" and r["auc"] == 1.0


def test_roc_endpoints_and_best(spark):
    ys = [0, 0, 1, 1, 0, 1]
    ss = [0.1, 0.4, 0.35, 0.8, 0.2, 0.9]
    roc = mt.roc_curve(_frame(spark, ys, ss)).toPandas().sort_values("threshold")
    assert roc.iloc[0]["sensitivity"] == 1.0 and roc.iloc[0]["specificity"] == 0.0
    assert roc.iloc[-1]["sensitivity"] == 0.0 and roc.iloc[-1]["specificity"] == 1.0
    assert len(roc) == len(set(ss)) + 1
    best = mt.best_threshold(mt.roc_curve(_frame(spark, ys, ss))).first()
    assert best["youden"] == pytest.approx(roc["youden"].max())


def test_sweep_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    ys = rng.integers(0, 2, 250)
    ss = np.round(rng.uniform(-0.05, 1.05, 250), 2)  # includes exact cut values
    sw = mt.threshold_sweep(_frame(spark, ys, ss)).toPandas().sort_values("threshold")
    assert len(sw) == 101
    for _, r in sw.iterrows():
        t = r["threshold"]
        pred = ss >= t
        assert r["tp"] == int(((ys == 1) & pred).sum())
        assert r["fp"] == int(((ys == 0) & pred).sum())
        assert r["tn"] == int(((ys == 0) & ~pred).sum())


def test_confusion_always_four_cells(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (0, 1)], "final int, pred int")
    r = mt.classification_report(df).first()
    assert (r["tn"], r["fn"], r["fp"], r["tp"]) == (0, 0, 1, 2)
    assert r["npv"] is None and r["specificity"] == 0.0 and r["accuracy"] == pytest.approx(2 / 3)


def test_threshold_table_rows(spark):
    ys = [0, 1, 1, 0, 1, 0, 1]
    ss = [0.2, 0.7, 0.6, 0.55, 0.9, 0.1, 0.45]
    t = mt.threshold_table(_frame(spark, ys, ss), 0.6).toPandas()
    assert list(t["rule"]) == ["base", "halfway", "best"]
    assert t["threshold"].tolist() == [0.5, 0.55, 0.6]
