"""Importance resampling against a brute-force version."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from edge import edge_rows, frame

from cohortlens.llm import importance_resampling as resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def runs(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(rows, target, buckets=10_000, least=20, share=(5, 100)):
    """(id, n_features, weight, score, rank) of every row, by the definition."""
    def hist(texts):
        h = collections.Counter()
        for t in texts:
            h.update(zlib.crc32(f.encode()) % buckets for f in runs(t)[1])
        return h
    s, t = hist([r[1] for r in rows]), hist(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for i, text, _ in rows:
        n, features = runs(text)
        weight = 0
        for f in features:
            b = zlib.crc32(f.encode()) % buckets
            weight += math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(features), weight, score, n])
    order = sorted((k for k in range(len(out)) if out[k][4] >= least), key=lambda k: (-out[k][3], out[k][0] is not None, out[k][0] or 0))
    rank = {k: j + 1 for j, k in enumerate(order[:len(order) * share[0] // share[1]])}
    return sorted((tuple([*x[:4], rank.get(k)]) for k, x in enumerate(out)), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("buckets,share", [(10_000, (5, 100)), (7, (50, 100))])
def test_edge_rows_equal_brute_force(spark, buckets, share):
    rows = edge_rows() + [(900, "Äb-c\x00d_E F9 " * 30 + "x" * 300 + " tail " + "é" * 90, "s"), (901, "İstanbul K ſ " * 10, None)]
    target = ["One two three w1 w2", None, "", "w5 W6 w7 " * 9]
    goal = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id int, text string, doc_id int")
    got = result(resampling.resample(frame(spark, rows), goal, buckets=buckets, share=share))
    assert got == brute(rows, target, buckets, share=share)


def test_a_third_of_rows_alike_and_ties(spark):
    rows = [(5, "same words again and " * 8, "s")] * 40 + [(None, None, None)] * 30 + [(i, f"w{i} " * 25, "s") for i in range(60)]
    goal = spark.createDataFrame([(1, "same words w3 w4")], "item_id bigint, text string")
    got = resampling.resample(frame(spark, rows), goal, share=(60, 100))
    assert result(got) == brute(rows, ["same words w3 w4"], share=(60, 100))


def test_empty_tables(spark):
    goal = spark.createDataFrame([], "item_id bigint, text string")
    assert resampling.resample(frame(spark, []), goal).collect() == []
    rows = [(1, "a b c " * 10, "s"), (2, "", "s")]
    assert result(resampling.resample(frame(spark, rows), goal, share=(1, 1))) == brute(rows, [], share=(1, 1))


def test_whole_tables(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, None) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    assert result(resampling.op13_importance_resampling(spark, path)) == brute(rows, target)


def test_slices_keep_words_whole(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("ab9é .中\x00~") for _ in range(5_000))
    whole = resampling.Features().of(text)
    monkeypatch.setattr(resampling, "SLICE", 7)
    cut = resampling.Features().of(text)
    assert whole[0] == cut[0] and np.array_equal(whole[1], cut[1])
