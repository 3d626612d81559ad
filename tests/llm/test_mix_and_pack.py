"""Source mixing and best-fit packing."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from edge import WORD, edge_rows, frame
from tokenizers import Tokenizer

from cohortlens.llm import best_fit_packing as packing
from cohortlens.llm import source_mixing as mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5):
    """Iterative: share by weight, stop at twice the source, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(w[s] for s in open_)
        grant = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += grant[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def mixed(spark, rows, **settings):
    return mixing.taken_words(*mixing.mix(frame(spark, rows), **settings)).collect()


@pytest.mark.parametrize("block,shard", [(512, 4096), (7, 16), (1, 3)])
def test_mix_meets_its_targets(spark, block, shard):
    rows = [r for r in edge_rows() if len(r[1] or "") < 10_000 or block > 100]
    got = mixed(spark, rows, block=block, shard_slots=shard)
    n = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((i, len(WORD.findall(t or ""))) for i, t, _ in rows)
    sizes, taken, targets = collections.Counter(), collections.Counter(), {}
    for i, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    source = {(r.source_size, round(r.target, 6)) for r in got}
    want = brute_targets(sizes)
    assert source == {(sizes[s], round(t, 6)) for s, t in want.items()}
    for r in got:
        taken[r.source_size] += r.taken
        targets[r.source_size] = r.target
        assert 0 <= r.taken <= 2 * r.size
    if len(set(sizes.values())) == len(sizes):
        assert all(abs(taken[k] - targets[k]) <= 0.5 for k in targets)
    assert n


def test_mix_again_is_the_same(spark):
    rows = edge_rows(3)
    assert sorted(map(tuple, mixed(spark, rows, block=16)), key=repr) == sorted(map(tuple, mixed(spark, list(reversed(rows)), block=16)), key=repr)


def test_mix_of_nothing(spark):
    assert mixed(spark, []) == []
    got = mixed(spark, [(1, None, None), (2, " ", "s")])
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 2


def test_mixed_documents_hold_the_taken_words(spark):
    rows = edge_rows(5)
    docs = frame(spark, rows)
    out = mixing.mixed_documents(docs, block=16)
    assert out.columns == docs.columns
    words = collections.Counter()
    known = collections.defaultdict(set)
    for i, t, _ in rows:
        known[i].add(t)
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
        assert any(set(WORD.findall(r.text)) <= set(WORD.findall(t or "")) for t in known[r.doc_id])
    taken = collections.Counter()
    for r in mixed(spark, rows, block=16):
        taken[r.doc_id] += r.taken
    assert +words == +taken


def test_permutation_is_one_and_undone(spark):
    from pyspark.sql import functions as F
    for n in (1, 2, 7, 1000):
        df = spark.range(n).withColumn("p", mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(3)))
        df = df.withColumn("q", mixing.permuted(F.col("p"), F.lit(n).cast("bigint"), F.lit(3), inverse=True))
        rows = df.collect()
        assert sorted(r.p for r in rows) == list(range(n)) and all(r.q == r.id for r in rows)


def brute_best_fit(lengths, capacity):
    free = []
    for x in sorted(lengths, reverse=True):
        fit = [f for f in free if f >= x]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - x)
        else:
            free.append(capacity - x)
    return len(free)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.choice([10, 32, 100])
        histogram = {x: rng.randrange(1, 12) for x in rng.sample(range(1, capacity + 1), rng.randrange(1, 10))}
        used = collections.defaultdict(list)
        ranks = collections.defaultdict(list)
        for length, a, b, base, offset in packing.plan(histogram, capacity):
            ranks[length] += range(a, b + 1)
            for i in range(b - a + 1):
                used[base + i].append((offset, length))
        assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(n)) for x, n in histogram.items()}
        for parts in used.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= capacity
        assert len(used) == brute_best_fit([x for x, n in histogram.items() for _ in range(n)], capacity)


def test_pieces_hold_the_tokenizers_ids(spark):
    rows = edge_rows() + [(90, "a  b  c<|endoftext|> d   e", "s"), (91, "it's  \n\n x\t\ty 12ab ", "s"), (92, "日本語 　 text", "s")]
    docs = frame(spark, rows)
    got = packing.pack(docs).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.pack(frame(spark, [])).collect() == []


def test_rank_of_a_hot_length_is_split(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 5L ELSE id % 7 END AS length")
    rows = packing.rank_within(df, "length", ["doc_id"], rows_per_window=100).collect()
    ranks = collections.defaultdict(list)
    for r in rows:
        ranks[r.length].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values()) and len(rows) == 5000


def test_ids_of_random_unicode_are_those_of_tokenizers():
    rng = random.Random(8)
    signs = ["a", "B", " ", "  ", "\n", "\t", "é", "ß", "中", "文", "👍", "\u200b", "\u00a0", "\u2003", "\u0301", "'s", "'", "12", "3", "_", "\x1c", "\x85", "\r\n", "ﬁ", "<|endoftext|>", "\u0085"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 60))) for _ in range(3000)]
    texts += ["".join(chr(c) for c in (rng.randrange(1, 0x11000) for _ in range(40)) if not 0xD800 <= c < 0xE000) for _ in range(500)]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    with packing.task_encoder("byte_bpe_50k") as encoder:
        got = [x.tolist() for a in range(0, len(texts), 500) for x in encoder.encode([x.encode() for x in texts[a:a + 500]])]
        assert len(encoder.count)
    assert got == want and not len(encoder.count) and not len(encoder.key)


def test_a_token_across_words_falls_back_to_whole_texts(monkeypatch):
    with packing.task_encoder("byte_bpe_50k") as encoder:
        monkeypatch.setattr(encoder, "n_bytes", encoder.n_bytes + 1)
        t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        texts = ["some words of a text", "more words"]
        assert [x.tolist() for x in encoder.encode([x.encode() for x in texts])] == [t.encode(x, add_special_tokens=False).ids for x in texts]
