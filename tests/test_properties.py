"""Property-based invariants (hypothesis): exact split sizes, exact AUC."""

import itertools
import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.operators import metrics as mt
from cohortlens.operators import sampling as sm

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(n=st.integers(1, 400), frac=st.floats(0.05, 0.95), seed=st.integers(0, 10_000))
def test_split_sizes_exact(spark, n, frac, seed):
    df = spark.range(0, n)
    s = sm.split_train_test(df, "id", frac, seed)
    rows = s.groupBy("split").count().collect()
    c = {r["split"]: r["count"] for r in rows}
    assert c.get("train", 0) == math.floor(frac * n)
    assert c.get("train", 0) + c.get("test", 0) == n


@SETTINGS
@given(ys=st.lists(st.integers(0, 1), min_size=4, max_size=60),
       data=st.data())
def test_auc_equals_pairwise(spark, ys, data):
    if len(set(ys)) < 2:
        ys = ys + [1 - ys[0]]
    ss = data.draw(st.lists(st.integers(0, 6), min_size=len(ys), max_size=len(ys)))
    df = spark.createDataFrame([(int(y), float(s)) for y, s in zip(ys, ss)], "final int, score double")
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y == 0]
    u = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p, q in itertools.product(pos, neg)) / (len(pos) * len(neg))
    want = u if np.median(neg) <= np.median(pos) else 1 - u
    assert abs(mt.auc(df).first()["auc"] - want) < 1e-12
