"""Lexical retrieval packing: exact round trip, padding, scores and neighbours."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from edge import edge_rows, frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import retrieval_packing as rp

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def token_ids(texts, end=0):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [x.ids + [end] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def assert_round_trip(rows, pieces, capacity=1024):
    """Every id of every document in exactly one piece, sequences gapless and padded only as allowed."""
    ids = token_ids([r[1] for r in rows])
    wanted = collections.Counter((r[0], tuple(x)) for r, x in zip(rows, ids))
    by_doc, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append(p)
        sequences[p.sequence_id].append(p)
    # rows that share an id and a length cover each of their ids as often as they occur
    for (doc, n), parts in by_doc.items():
        texts = [x for (d, x), k in wanted.items() for _ in range(k) if d == doc and len(x) == n]
        cover = collections.Counter()
        for p in parts:
            assert any(zlib.crc32(np.array(x[p.start:p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for x in texts)
            cover.update(range(p.start, p.start + p.length))
        assert cover == dict.fromkeys(range(n), len(texts))
    assert sum(len(x) * k for (_, x), k in wanted.items()) == sum(p.length for p in pieces)
    for parts in sequences.values():
        end = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == end and p.length > 0
            end += p.length
        assert end <= capacity and end & (end - 1) == 0
    return sequences


@pytest.mark.parametrize("shard_tokens", [1 << 18, 3000])
def test_edge_rows_round_trip(spark, shard_tokens):
    rows = edge_rows()
    pieces = rp.pack(frame(spark, rows), shard_tokens=shard_tokens).collect()
    assert_round_trip(rows, pieces)
    assert all(zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length for p in pieces)


def test_small_sequences(spark):
    rows = edge_rows()[:12] + edge_rows()[13:20]
    pieces = rp.pack(frame(spark, rows), capacity=16, shard_tokens=100).collect()
    assert_round_trip(rows, pieces, 16)


def test_empty_table(spark):
    assert rp.pack(frame(spark, [])).collect() == []
    one = rp.pack(frame(spark, [(None, None, None)])).collect()
    assert [(p.doc_id, p.start, p.length, p.doc_tokens, p.offset) for p in one] == [(None, 0, 1, 1, 0)]


def test_whole_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = rp.op12_retrieval_packing(spark, path)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert_round_trip(rows, got.collect())


def topics(n, seed=4):
    """Documents of three topics: a third of the words are the topic's own."""
    rng = random.Random(seed)
    words = {t: [f"{t}{rng.randrange(10**6)}x" for _ in range(30)] for t in ("apple", "river", "stone")}
    common = [f"word{i}" for i in range(200)]
    return [(i, " ".join(rng.choice(words[t] if rng.random() < 0.3 else common) for _ in range(rng.randrange(20, 60))), t)
            for i in range(n) for t in [rng.choice(sorted(words))]]


def test_scores_equal_bm25():
    rows = topics(60)
    texts = [r[1].lower() for r in rows]
    found = rp._terms([t.encode() for t in texts], rp.Hasher())
    tf = [collections.Counter(WORD.findall(t)) for t in texts]
    df = collections.Counter(w for c in tf for w in c)
    mean = sum(sum(c.values()) for c in tf) / len(tf)
    counters = np.zeros(1 << rp.COUNTER_BITS, np.int64)
    for _, terms, _ in found:
        np.add.at(counters, terms >> np.uint32(32 - rp.COUNTER_BITS), 1)
    index = rp.Index([t for _, t, _ in found], [c for *_, c in found], np.array([n for n, *_ in found]), rp.idf(counters, len(rows)), mean)
    for q in (0, 17, 59):
        want = [sum(max(0.0, math.log((len(rows) - df[w] + 0.5) / (df[w] + 0.5))) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
                    for w in tf[q] if w in c) for c in tf]
        assert np.allclose(index.scores(q), want, rtol=1e-5)
        assert index.scores(q)[q] == index.scores(q).max()


def test_windows_hold_neighbours(spark):
    rows = topics(400)
    topic = {r[0]: r[2] for r in rows}
    sequences = assert_round_trip(rows, rp.pack(frame(spark, rows)).collect())
    share = []
    for parts in sequences.values():
        tokens = collections.Counter()
        for p in parts:
            tokens[topic[p.doc_id]] += p.length
        share.append(max(tokens.values()) / sum(tokens.values()))
    assert np.mean(share) > 0.85  # by chance 0.45


def test_a_third_of_rows_alike_spreads_over_shards(spark):
    rows = [(1, "the same text for all of these rows " * 4, "s")] * 150 + topics(300)
    pieces = rp.pack(frame(spark, rows), shard_tokens=2000).collect()
    assert_round_trip(rows, pieces)
    shards = collections.Counter()
    for p in pieces:
        if p.sequence_id >= 0:
            shards[p.sequence_id >> 32] += p.length
    assert len(shards) > 10 and max(shards.values()) < 3 * 2000


def test_shard_plan_covers_every_key():
    plan = rp.shard_plan({0: 10, 3: 5, 4: 100, 9: 4, 12: 30}, 30)
    assert plan == [(0, 0, 1), (3, 0, 1), (4, 1, 4), (9, 5, 1), (12, 6, 1)]
    assert rp.shard_plan({}, 30) == []


def test_only_words_go_to_python_for_keys(spark):
    """One pass for the keys, also below the filter that a join on them brings, and no other column in it."""
    rests = rp.blocks(frame(spark, edge_rows()))
    keys = spark.createDataFrame([(1, 2)], "key int, first bigint")
    joined = rp.keyed(rests, np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.float32)).join(F.broadcast(keys), "key")
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("MapInArrow") == 1  # the blocks
