"""Line dedup, Jaccard join and components against brute force."""

import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from edge import WORD, edge_rows, frame
from pyspark.sql import functions as F

from cohortlens.llm import jaccard_join, line_dedup
from cohortlens.llm.components import components
from cohortlens.llm.words import Hasher, scan, shingles


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingle_set(text, k):
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def keep_staged(monkeypatch, module):
    """The last table that ``module`` stages under each name; none is deleted."""
    staged, write = {}, module.stage

    def stage(df, name):
        staged[name] = write(df, name)
        return staged[name]

    monkeypatch.setattr(module, "stage", stage)
    monkeypatch.setattr(module, "discard", lambda *tables: None)
    return staged


def brute_classes(rows, k, num, den):
    sets = [(i, shingle_set(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if s and t and den * len(s & t) >= num * len(s | t):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted(((i, len(shingle_set(t, k)), None if i is None else find(i)) for i, t in rows), key=repr)


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 8, 10), (1, 1, 2)])
def test_classes_match_brute_force_on_edge_rows(spark, k, num, den):
    rows = edge_rows()
    got = jaccard_join.classes(frame(spark, rows), k, num, den).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_classes([(i, t) for i, t, _ in rows], k, num, den)


@pytest.mark.parametrize("limit", [0, 12, 40])
def test_every_boundary_finds_the_same_links(spark, monkeypatch, limit):
    rng = random.Random(limit)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = base[:rng.choice([9, 10, 11, 12, 19, 20, 21, 30, 44, 60])]
        for _ in range(rng.randrange(3)):
            w = w[:(j := rng.randrange(len(w)))] + rng.choice([[], ["z%d" % rng.randrange(9)]]) + w[j + 1:]
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard_join, "boundary", lambda costs, num, den: limit)
    got = jaccard_join.classes(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 9, 10).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_classes(rows, 3, 9, 10)


def test_classes_of_an_empty_table(spark):
    assert jaccard_join.classes(frame(spark, [])).collect() == []


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d e f g h", "s"), (3, "a b c d e f g h", "s"), (9, "x y", "s"), (None, "a b c d e f g h", "s"), (7, None, "s")]
    out = jaccard_join.deduplicated(frame(spark, rows))
    assert sorted(str(r.doc_id) for r in out.collect()) == ["3", "7", "9", "None"] and out.columns == frame(spark, rows).columns


def test_boundary_is_where_lists_become_cheaper():
    costs = [(n, 100, 100 * 2 * 30.0) for n in range(1, 40)]
    b = jaccard_join.boundary(costs, 9, 10)
    assert b == 20  # 20 shingles have 1 + 20 + 190 subsets, 19 have 20
    assert jaccard_join.boundary([], 9, 10) == 0


@pytest.mark.parametrize("limit", [None, 0, 14, 40])
def test_links_of_light_and_heavy_sets_equal_brute_force(spark, monkeypatch, limit):
    """Sets of 8 to 24 words, near each other: with a boundary of 14 both halves have links, and links across it."""
    rng = random.Random(6)
    rows = []
    for g in range(25):
        base = [f"g{g}w{i}" for i in range(rng.randrange(9, 24))]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"u{rng.randrange(10 ** 5)}"
            rows.append((len(rows), " ".join(w + rng.sample(base, 2))))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (None, rows[3][1]), (502, None), (503, "")]
    sets = {i: frozenset((t or "").split()) for i, t in rows if i is not None}
    least = {}
    for i, s in sorted(sets.items()):
        least.setdefault(s, i)
    different = [(i, s) for s, i in least.items() if s]
    want = {(min(a, b), max(a, b)) for a, s in different for b, t in different if a != b and 10 * len(s & t) >= 8 * len(s | t)}
    sizes = [{len(sets[a]) < 14, len(sets[b]) < 14} for a, b in want]
    assert all(x in sizes for x in ({True}, {False}, {True, False}))
    if limit is not None:
        monkeypatch.setattr(jaccard_join, "boundary", lambda *_: limit)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {(r.a, r.b) for r in jaccard_join.links(df, 1, 8, 10).collect()} == want
    if limit == 14:
        n = collections.Counter(x for pair in want for x in pair)
        got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.link_counts(df, 1, 8, 10).collect()}
        assert got == {None: (None, 0), 502: (None, 0), 503: (None, 0)} | {i: (least[s], n[least[s]]) for i, s in sets.items() if s}


def test_a_large_group_of_near_copies_does_not_emit_its_pairs(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(130)]
    rows = []
    for i in range(200):
        w = list(base)
        w[rng.randrange(130)] = f"u{i}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(base[:130 - i] + [f"v{j}" for j in range(i)])) for i in range(1, 12)]
    staged = keep_staged(monkeypatch, jaccard_join)
    # first links that leave the group in twenty parts
    parts = spark.createDataFrame([(i % 20, i) for i in range(20, 200)], "a bigint, b bigint")
    monkeypatch.setattr(jaccard_join, "first_links", lambda *_: parts)
    got = jaccard_join.classes(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 9, 10).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_classes(rows, 3, 9, 10)
    assert staged["join-more"].count() <= 2 * len(rows)


def test_parts_that_one_round_of_chains_leaves_do_not_emit_their_pairs(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(130)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(130)] = f"u{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w[:130 - rng.randrange(4)] if rng.random() < .5 else w)))
    staged = keep_staged(monkeypatch, jaccard_join)
    # nothing is linked before; one round of chains left 8204 pairs
    none = spark.createDataFrame([], "a bigint, b bigint")
    monkeypatch.setattr(jaccard_join, "first_links", lambda *_: none)
    got = jaccard_join.classes(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 9, 10).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_classes(rows, 3, 9, 10)
    assert staged["join-more"].count() <= len(rows)


def test_components_match_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    got = {r.u: r.v for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    root = {x: x for x in itertools.chain(*links)}
    for _ in range(len(root)):
        for a, b in links:
            m = min(root[a], root[b])
            root[a] = root[b] = m
    assert got == {x: r for x, r in root.items() if x != r}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def brute_lines(rows):
    """Text of each row: ordered by doc_id (null first), lines with an earlier similar line gone."""
    order = sorted({(-1 if i is None else i, t) for i, t in rows if t is not None})
    at = [(i, no, t, line, frozenset(WORD.findall(line))) for i, t in order for no, line in enumerate(t.split("\n"))]
    first, gone, lists = {}, set(), collections.defaultdict(list)
    for k, x in enumerate(at):
        if x[4]:
            first.setdefault(x[4], k)
    for s, k in sorted(first.items(), key=lambda x: x[1]):
        shared = collections.Counter(j for w in s for j in lists[w])
        if any(10 * n >= 8 * (len(s) + len(at[j][4]) - n) for j, n in shared.items()):
            gone.add(s)
        for w in s:
            lists[w].append(k)
    out = collections.defaultdict(list)
    for k, (i, no, t, line, s) in enumerate(at):
        if not s or (first[s] == k and s not in gone):
            out[i, t].append(line)
    return sorted(((i, None if t is None else "\n".join(out[-1 if i is None else i, t])) for i, t in rows), key=repr)


def test_line_dedup_matches_brute_force_on_edge_rows(spark):
    rows = edge_rows()
    out = line_dedup.deduplicated(frame(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == brute_lines([(i, t) for i, t, _ in rows])
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
    assert line_dedup.deduplicated(frame(spark, [])).collect() == []


def test_line_dedup_of_many_similar_lines(spark):
    rng = random.Random(7)
    base = [f"v{i}" for i in range(30)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(3):
            w = list(base[:rng.choice([4, 5, 10, 30])])
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = f"u{rng.randrange(400)}"
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    got = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == brute_lines(rows)


def test_long_lines_that_only_share_words_are_no_pairs(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(2000)]
    rows = [(i, " ".join(rng.sample(vocabulary, 170))) for i in range(150)]
    rows += [(200 + i, " ".join(rows[i][1].split()[:-3] + ["new", "words"])) for i in range(10)]
    staged = keep_staged(monkeypatch, line_dedup)
    got = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == brute_lines(rows)
    assert staged["line-pairs"].count() <= len(rows)


def test_line_dedup_of_texts_that_share_an_id(spark):
    rng = random.Random(11)
    base = [[f"p{k}w{i}" for i in range(12)] for k in range(6)]
    rows = []
    for i in [None] * 40 + [5] * 20 + [7] * 3 + list(range(10, 40)):
        lines = [" ".join(f"z{rng.randrange(10 ** 6)}" for _ in range(8)) for _ in range(4)]
        for _ in range(3):
            w = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                w[rng.randrange(12)] = f"u{rng.randrange(400)}"
            lines.insert(rng.randrange(len(lines) + 1), " ".join(w))
        rows.append((i, "\n".join(lines)))
    rows += [rows[0]] * 3 + [rows[45]] * 2 + [(None, None), (5, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    # brute_lines orders by id: each text gets one by doc_id and hash
    order = {(r.doc_id, r.text): k for k, r in enumerate(df.distinct().orderBy("doc_id", F.xxhash64("text")).collect())}
    back = {k: i for (i, _), k in order.items()}
    got = line_dedup.deduplicated(df).collect()
    want = brute_lines([(order[x], x[1]) for x in rows])
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(((back[k], t) for k, t in want), key=repr)


def test_rarity_counts_all_words_and_translates_no_plain_text(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "RARITY_BITS", 4)
    rows = [(1, "a b\nc\ta\n\nb a"), (2, None), (3, ""), (4, "a\x0bb\rc\fd\u00a0d " * 3), (5, "b\n" * 40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    words = [w for _, t in rows for line in (t or "").split("\n") for w in line.translate(dict.fromkeys(map(ord, "\t\x0b\f\r"), " ")).split(" ") if w]
    counter = F.shiftrightunsigned(F.xxhash64("w"), 60)
    want = {r.c: r.n for r in spark.createDataFrame([(w,) for w in words], "w string").groupBy(counter.alias("c")).agg(F.count("*").alias("n")).collect()}
    blank = spark.createDataFrame([("",)], "w string").select(counter).first()[0]
    levels = line_dedup.rarity_levels(df)
    assert [x for i, x in enumerate(levels) if i != blank] == [min(127, int(4 * np.log2(want[i]))) if i in want else 0 for i in range(16) if i != blank]
    found = str(line_dedup._text_words(F.col("text")))
    assert found.count("translate") == 1 and "CASE WHEN" in found  # the one for other white space


def test_sets_of_a_batch_take_few_bytes_at_once(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10 ** 4)}" for _ in range(rng.randrange(400))) for _ in range(3000)] + [None, "", "x " * 10 ** 6]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    taken, real = [], jaccard_join.scan
    monkeypatch.setattr(jaccard_join, "scan", lambda part, lower: taken.append((len(part), sum(map(len, part)))) or real(part, lower=lower))
    hasher = Hasher()
    got = {i: h.tolist() for i, h in jaccard_join._sets(batch, hasher, 3)}
    assert max(size for n, size in taken if n > 1) <= 1 << 19 and sum(n for n, _ in taken) == len(texts)
    monkeypatch.setattr(jaccard_join, "BYTES", 1 << 30)
    assert got == {i: h.tolist() for i, h in jaccard_join._sets(batch, Hasher(), 3)}
    assert len(got) == sum(bool((t or "").split()) for t in texts)


def test_words_and_shingles_of_bytes():
    texts = [t or "" for _, t, _ in edge_rows()]
    words = scan([t.encode() for t in texts])
    h = words.hashes(Hasher())
    found = [bytes(words.data[a:b]).decode() for a, b in zip(words.starts, words.ends)]
    assert found == [w for t in texts for w in WORD.findall(t)]
    by_word = {}
    assert all(by_word.setdefault(w, x) == x for w, x in zip(found, h.tolist())) and len(set(by_word.values())) == len(by_word)
    s, d = shingles(words, h, 3)
    want = {i: len(set(tuple(w[j:j + 3]) for j in range(len(w) - 2)) or ([1] if w else [])) for i, t in enumerate(texts) for w in [WORD.findall(t)]}
    assert {i: len(np.unique(s[d == i])) for i in range(len(texts))} == want
