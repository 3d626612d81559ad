"""Fingerprints, quality, toxicity, HTML and WARC."""

import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from edge import WORD, edge_rows, frame

from cohortlens.llm import boosting, html_text, quality_neighbours, quality_rules, simhash, toxicity, warc
from cohortlens.llm import automaton
from cohortlens.llm.automaton import Entry, LexiconAutomaton
from cohortlens.llm.labels import training_rows
from cohortlens.llm.words import chunks
from cohortlens.llm.registry import ORACLES, QUERIES
from cohortlens.llm.tables import shared_path

SMALL = "/root/testdata/sf0.001"
PAGES = "page_id bigint, url string, html string, score double"


def test_edited_texts_and_fingerprints(spark):
    rows = [r for r in edge_rows() if r[0] is not None and r[0] < 40]
    rows = list({r[0]: r for r in rows}.values())
    got = {r.doc_id: r for r in simhash.sign(frame(spark, rows)).collect()}
    order = sorted((i, t or "") for i, t, _ in rows)
    fp = {}
    for k, (i, t) in enumerate(order):
        follow = order[(k + 1) % len(order)]
        n = len(t) // 4
        assert got[i].edited_sha256 == hashlib.sha256((t[:len(t) - n] + follow[1][:n]).encode()).hexdigest()
        assert got[i].n_chars == len(t) and got[i].next_fp == got[follow[0]].fp
        assert fp.setdefault(t, got[i].fp) == got[i].fp


def test_signing_nulls_repeats_and_nothing(spark):
    rows = edge_rows()
    got = simhash.sign(frame(spark, rows)).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _, _ in rows)
    assert {r.fp for r in got if not r.n_chars} == {0}
    assert simhash.sign(frame(spark, [])).collect() == []


@pytest.mark.parametrize("radius,blocks", [(0, 1), (3, 6), (3, 5), (2, 4)])
def test_block_tables_find_all_near_fingerprints(spark, radius, blocks):
    rng = random.Random(radius)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(6):
            fps.add(x)
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    got = {(r.a, r.b) for r in simhash.near_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp bigint"), radius, blocks).collect()}
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) % (1 << 64)).bit_count() <= radius}
    assert got == want


def brute_statistics(t):
    w = WORD.findall(t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i in range(len(w) - 2) if count[tuple(w[i:i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(covered)


def test_statistics_and_base_rules(spark):
    rows = edge_rows() + [(100, "a b c\na b c\n x\na b c a b c", "s"), (101, "p q " * 60, "s")]
    forest = boosting.train(np.zeros((0, len(quality_rules.FEATURES))), np.zeros(0), {})
    got = quality_rules.judge(frame(spark, rows), forest).collect()
    want = collections.Counter()
    for i, t, _ in rows:
        s = brute_statistics(t)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        want[(i, *s, failed, not failed)] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == want
    assert quality_rules.judge(frame(spark, []), forest).collect() == []


def test_boosting_is_monotone_and_flat_scoring_walks_the_trees():
    rng = np.random.default_rng(0)
    x = rng.random((1500, 4))
    y = ((x[:, 0] + np.sin(6 * x[:, 1]) + 0.3 * rng.standard_normal(1500)) > 1).astype(float)
    forest = boosting.train(x, y, {0: 1, 2: -1}, trees=30)
    grid = np.linspace(0, 1, 50)
    for _ in range(20):
        row = np.tile(rng.random(4), (50, 1))
        for j, sign in ((0, 1), (2, -1)):
            z = row.copy()
            z[:, j] = grid
            assert (np.diff(forest.score(z)) * sign >= -1e-12).all()
    assert ((forest.score(x) > 0.5) == y).mean() > 0.85
    for row in x[:20]:
        total = forest.base
        for k in forest.roots:
            while forest.left[k] != k:
                k = forest.left[k] if row[forest.feature[k]] <= forest.threshold[k] else forest.right[k]
            total += forest.value[k]
        assert forest.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_matches_edit_distance():
    rng = random.Random(1)
    entries = [Entry("".join(rng.choice("abé") for _ in range(rng.randint(2, 6))), rng.random() < 0.6, rng.randint(0, 2), 1.0) for _ in range(14)]
    words = ["".join(rng.choice("abéd") for _ in range(rng.randint(0, 10))) for _ in range(2500)]
    for word, hit in zip(words, LexiconAutomaton(entries).match(words)):
        found = [i for i, e in enumerate(entries) if e.edits >= (levenshtein(word, e.text) if e.whole else min(levenshtein(word[:k], e.text) for k in range(len(word) + 1)))]
        assert (hit is not None) == bool(found)
        assert hit is None or hit[1] in found
    assert LexiconAutomaton([]).match(["a"]) == [None]


def test_automaton_gives_the_least_edits_of_stems():
    rng = random.Random(3)
    entries = [Entry("".join(rng.choice("abé") for _ in range(rng.randint(3, 6))), rng.random() < 0.4, rng.randint(0, 2), 1.0) for _ in range(14)]
    words = ["".join(rng.choice("abéd") for _ in range(rng.randint(0, 10))) for _ in range(2500)]
    for word, hit in zip(words, LexiconAutomaton(entries).match(words)):
        costs = [levenshtein(word, e.text) if e.whole else min(levenshtein(word[:k], e.text) for k in range(len(word) + 1)) for e in entries]
        assert (hit and hit[0]) == min((c for c, e in zip(costs, entries) if c <= e.edits), default=None)


def toxic_corpus(n=600, seed=1):
    rng = random.Random(seed)
    clean = ["".join(rng.choice("aeioulmnst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    bad = ["grumblewort", "snarkface", "vexlump"]
    rows = []
    for i in range(n):
        w = [rng.choice(clean) for _ in range(rng.randrange(20, 90))]
        if i % 5 == 0:
            for _ in range(rng.randrange(2, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), "s"))
    return rows


def test_toxicity_learns_words_misspellings_and_quotation(spark):
    rows = toxic_corpus()
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i, _, _ in rows], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(frame(spark, rows), labels)
    assert {e.text for e in model.entries} >= {"grumblewort", "snarkface", "vexlump"}
    tests = [(1000, "so mi tana grümblewort lima snarkfase somi", "s"), (1001, "lima nato sila mani tolu", "s"), (1002, None, "s"), (1003, "", "s"),
             (1004, 'he said "snarkface" lima nato sila mani tolu ' * 1 + "lima nato " * 60, "s"), (1005, "you snarkface " + "lima nato " * 3, "s"), (None, "vexlump vexlump", "s"), (None, "vexlump vexlump", "s")]
    out = toxicity.scored(frame(spark, tests), model)
    got = out.collect()
    score = {r.doc_id: r["__score"] for r in got}
    assert len(got) == len(tests) and all(0 <= r["__score"] <= 1 for r in got)
    assert score[1000] > 0.5 > score[1001] == score[1002] == score[1003]
    assert score[1005] > 0.5 > score[1004] and score[None] > 0.5
    kept = toxicity.without_toxic(frame(spark, rows), labels)
    assert kept.columns == frame(spark, rows).columns and {r.doc_id for r in kept.collect()} == {i for i, _, _ in rows if i % 5}
    assert toxicity.scored(frame(spark, []), model).collect() == []


def test_toxicity_copies_do_not_push_out_a_rare_vocabulary(spark):
    rows = toxic_corpus()
    rng = random.Random(5)
    rare = [(1000 + i, " ".join(rng.choice(["heute", "morgen", "gestern", "immer", "wieder"]) + str(rng.randrange(90)) for _ in range(20)) + " schnöselkopf", "t") for i in range(25)]
    copies = [(5000 + i, rows[0][1], "s") for i in range(2500)]
    docs = frame(spark, rows + rare + copies)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0 or i >= 1000)) for i, _, _ in rows + rare + copies], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert any("schnöselkopf".startswith(e.text) for e in model.entries)
    got = toxicity.scored(frame(spark, rows + rare), model).collect()
    assert {r.doc_id for r in got if r["__toxic"]} == {i for i, _, _ in rows + rare if i % 5 == 0 or i >= 1000}


def test_toxicity_finds_misspellings_of_even_lexicons_and_stems(spark):
    rng = random.Random(8)
    bad = ["".join(rng.choice("bdgkprtvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(40)]
    rows = [(i, t.replace("grumblewort", "lima").replace("snarkface", "tolu").replace("vexlump", "sila"), s) for i, t, s in toxic_corpus(4000)]
    rows = [(i, t if i % 5 else f"{t} {bad[i // 5 % 40]}{rng.choice(['', 'x', 'ung', 'er'])} " + rng.choice(["mani", "nato"]), s) for i, t, s in rows]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i, _, _ in rows], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(frame(spark, rows), labels)
    assert any(not e.whole for e in model.entries) and all(e.edits for e in model.entries if len(e.text) >= 5)
    tests = [(k, f"lima {b[:2]}q{b[3:]} tolu sila", "s") for k, b in enumerate(bad)] + [(1000, "lima tolu sila", "s")]
    score = {r.doc_id: r["__score"] for r in toxicity.scored(frame(spark, tests), model).collect()}
    assert all(score[k] > score[1000] for k in range(40))


def test_no_candidate_for_the_lexicon_is_dropped(spark):
    """Many more than 20,000 terms that all occur in enough toxic texts, the rarest among them."""
    words = [f"{a}{b}{c}{d}" for a in "bcdfg" for b in "aeiouyxz" for c in "klmnprst" for d in ["oba", "ide", "urn", "yst", "ema", "ofi", "uge", "ahl"] * 1]
    words = [w + s for w in words for s in ("a", "en", "is", "o", "um", "y", "eth", "aw", "ip", "ost")]
    assert len(words) > 20_000
    rows = [(i, " ".join(words), 1) for i in range(6)] + [(10 + i, "raregrumble", 1) for i in range(5)] + [(100 + i, f"clean words number {i}", 0) for i in range(600)]
    rows = [(i, t + (f" copy{i}" if y else ""), y) for i, t, y in rows]
    entries = toxicity.lexicon(spark.createDataFrame(rows, "doc_id bigint, text string, label int"))
    assert any("raregrumble".startswith(e.text) for e in entries)


def test_a_label_is_one_text_however_many_rows_repeat_its_id(spark):
    docs = spark.createDataFrame([(1, f"text {i % 7}") for i in range(500)] + [(2, None), (None, "x"), (3, "y")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)] + [(i, 1) for i in range(4, 9)], "doc_id bigint, toxic int")
    got = sorted((r.doc_id, r.text, r.label) for r in training_rows(docs, labels, "toxic", 100).collect())
    assert got == [x for x in [(1, "text 0", 1), (2, "", 0)] if zlib.crc32(str(x[0]).encode()) % 5]


def test_chunks_are_bounded_by_rows_and_whole():
    texts = [b"one"] * 2500 + [b"x" * 5000]
    parts = list(chunks(texts, 4000, 1000))
    assert [len(p) for _, p in parts] == [1000, 1000, 500, 1] and [a for a, _ in parts] == [0, 1000, 2000, 2500]


def test_a_forgetful_automaton_matches_alike(monkeypatch):
    rng = random.Random(9)
    entries = [Entry("".join(rng.choice("abcde") for _ in range(rng.randrange(4, 8))), bool(i % 2), i % 3 > 0, 1.0) for i in range(60)]
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 10))) for _ in range(4000)]
    whole = LexiconAutomaton(entries).match(words)
    monkeypatch.setattr(automaton, "MOST_STATES", 50)
    small = LexiconAutomaton(entries)
    assert [h for a in range(0, 4000, 200) for h in small.match(words[a:a + 200])] == whole


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(frame(spark, edge_rows()), none)
    assert model.entries == [] and len(toxicity.scored(frame(spark, edge_rows()), model).collect()) == len(edge_rows())


@pytest.mark.parametrize("name,label,least", [("op6_toxicity", "toxic", 0.8), ("op9_quality_neighbours", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    path = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES[name](spark, path).collect()}
    rows = [r for r in spark.read.parquet(f"{path}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out for r in rows)
    assert sum(got[r.doc_id].predicted == r[label] for r in rows) >= least * len(rows)


def test_neighbours_are_exact_and_edges_defined(spark):
    rng = np.random.default_rng(3)
    space = quality_neighbours.Space(np.ones(quality_neighbours.TERMS, np.float32), rng.standard_normal((quality_neighbours.TERMS, 8)).astype(np.float32),
                                     (v := rng.standard_normal((200, 8)).astype(np.float32)) / np.linalg.norm(v, axis=1, keepdims=True), (rng.random(200) < 0.5).astype(float))
    counts = rng.integers(0, 3, (700, quality_neighbours.TERMS))
    counts[5] = 0
    got = space.score(counts)
    for i in (0, 5, 699):
        cosine = (space.project(counts[i:i + 1]) @ space.vectors.T)[0]
        near = np.argsort(-cosine)[:quality_neighbours.NEIGHBOURS]
        w = np.maximum(cosine[near], 0).astype(float) ** 4 + 1e-12
        assert got[i] == pytest.approx(space.labels.mean() if i == 5 else (w * space.labels[near]).sum() / w.sum(), rel=1e-3)
    rows = edge_rows()
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    empty = quality_neighbours.fit(frame(spark, rows), none)
    out = quality_neighbours.classify(frame(spark, rows), empty).collect()
    assert len(out) == len(rows) and {r.score for r in out} == {0.5}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (7, None, 0)], "doc_id bigint, quality int, toxic int")
    some = quality_neighbours.classify(frame(spark, rows), quality_neighbours.fit(frame(spark, rows), labels)).collect()
    assert len(some) == len(rows) and all(0 <= r.score <= 1 for r in some)
    assert quality_neighbours.classify(frame(spark, []), empty).collect() == []


def test_minimum_cut_is_least():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randint(1, 7)
        gain = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 6)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(label):
            return sum(abs(g) for g, x in zip(gain, label) if (g > 0) != x and g) + sum(c for a, b, c in edges if label[a] != label[b])

        assert cost(html_text.minimum_cut(gain, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))


ARTICLE = ("<h1>Title &amp; more</h1><p>First part of the story, with enough words to read &#233;.<p>Second   part\n is <b>bold</b> and here<br>goes on."
           "<ul><li>One item</li><li>Two <a href=z>linked</a> items</li></ul>")
TEXT = "Title & more\n\nFirst part of the story, with enough words to read é.\n\nSecond part is bold and here goes on.\n\nOne item\n\nTwo linked items"
PAGE = ("<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1><p>Welcome to the site of all sites today</p></header>"
        "<nav><ul><li><a href=x>Home</a></li></ul></nav><div class='cookie-notice'><p>We use cookies to make this site better for you and us.</p></div><!-- c --><script>var t='</p>'</script>"
        "%s<aside><p>Related stories that you may also like to read now</p></aside><form><p>Your mail</p><button>Go</button></form>"
        "<section id='comments'><p>I liked this article so much, thanks for writing it all.</p></section><footer>&copy; 2020</footer></body></html>")


@pytest.mark.parametrize("body", ["<article>%s</article>", "<main>%s</main>", "<div class='post-content'>%s</div>", "<article>%s<div class=ad>Buy this thing now</div></article>"])
def test_main_text_of_pages(body):
    assert html_text.main_text(PAGE % (body % ARTICLE)) == TEXT


@pytest.mark.parametrize("body", ["<div class='content with-sidebar'><article>%s</article></div>", "<div class='side social' id=search><main>%s</main></div>",
                                  "<div class='post hasSidebar no-right-sidebar'>%s</div>", "<article title='The hidden garden' data-id=ad data-class='menu'>%s</article>",
                                  "<article>%s<div hidden><p>More words that nobody is ever meant to see on this page</p></div></article>",
                                  "<article>%s<div class='related'><p>More stories that you may also like to read some day</p></div></article>",
                                  "<div style='display: none'><article><p>More words that nobody is ever meant to see on this page</p></article></div><article>%s</article>"])
def test_marks_count_from_the_article_inward(body):
    assert html_text.main_text(PAGE % (body % ARTICLE)) == TEXT


@pytest.mark.parametrize("start", ["<head><meta charset=utf-8><title>t</title><link href=x>", "<html><head><style>p{}</style>", "<html><head><title>t</title></head>", "<head>\n<script>x</script>\n<body>"])
def test_head_without_end_tag(start):
    assert html_text.main_text(f"{start}<article>{ARTICLE}</article>") == TEXT
    plain = "plain text with more than enough words to be the content of a page"
    assert html_text.main_text(f"{start}{plain}") == html_text.main_text(f"{start}{plain}<br>") == plain


MORE = "".join(f"<p>Paragraph {i} of the article has quite a few words in it, more than a menu.</p>" for i in range(3))
MORE_TEXT = "\n\n".join(f"Paragraph {i} of the article has quite a few words in it, more than a menu." for i in range(3))


@pytest.mark.parametrize("part,text", [
    ('<p>See <svg class="i"/> the icon in a sentence that is long enough</p>', "See the icon in a sentence that is long enough"),
    ("<p>See <svg><g><svg><text>no</text></svg><path d='x'/></g><text>no</text></svg> the icon in a long enough sentence</p>", "See the icon in a long enough sentence"),
    ("<p>See the icon in a sentence that is long enough <svg><path>", "See the icon in a sentence that is long enough"),
    ("<p>Pick <template><p>no</p></template>one of the many words of this sentence</p>", "Pick one of the many words of this sentence"),
    ("<div>Choose one of these many things here <select><option>a<option>b</div>", "Choose one of these many things here"),
    ("<p>Choose one of these many things here <select><option>a", "Choose one of these many things here"),
    ("<p>The sum <math><mi>a</mi>+<mi>b</mi></math> is a formula in a sentence of words.</p>", "The sum a+b is a formula in a sentence of words."),
    ("<p class='notice-of-death'>The family gave a notice of death in the paper of today.</p>", "The family gave a notice of death in the paper of today."),
    ("<p>These are the books that the text above refers to:</p><ul><li><a href=x>A first book</a></li><li><a href=y>A second book</a></li></ul>",
     "These are the books that the text above refers to:\n\nA first book\n\nA second book")])
def test_no_part_of_an_article_takes_the_rest_with_it(part, text):
    assert html_text.main_text(f"<article>{part}{MORE}</article>") == text + "\n\n" + MORE_TEXT


def test_deep_pages_take_time_in_proportion():
    page = "".join(f"<div>level {i} text" for i in range(20_000))
    start = time.time()
    assert len(html_text.blocks(page)) == 20_000
    assert time.time() - start < 5


def test_extract_edges(spark):
    rows = [(1, "u", None, 0.0), (2, None, "", 0.0), (None, "u", "<p", 0.0), (4, "u", "<article><p>" + "word " * 50_000, 0.0), (5, "u", "<script>x", 0.0),
            (6, "u", "plain text with more than enough words to be the content of a page", 0.0), (6, "u", "plain text with more than enough words to be the content of a page", 0.0)]
    got = collections.Counter((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect())
    long, plain = ("word " * 50_000).strip(), rows[5][2]
    assert got == collections.Counter([(1, "u", "", 0), (2, None, "", 0), (None, "u", "", 0), (4, "u", long, len(long)), (5, "u", "", 0), (6, "u", plain, len(plain)), (6, "u", plain, len(plain))])
    assert html_text.extract(spark.createDataFrame([], PAGES)).collect() == []


@pytest.mark.parametrize("records", [[b"a"], [b"", b""], [b"abc" * 10] * 3, [bytes([i % 7, i % 11]) * 300 + b"%d" % i for i in range(400)]])
def test_archive_round_trip(records):
    content = warc.encode_archive(records)
    assert content[:4] == b"\x5d\x2a\x4d\x18" and list(warc.decode_archive(content)) == records
    with pytest.raises(ValueError):
        list(warc.decode_archive(content[:-3]))


def test_references_of_an_archive_resolve(spark):
    from pyarrow import fs
    rows = [(i, f"http://h/{i}", "<p>same</p>" * 200, 0.0) for i in range(1, 9)] + [(20, "u", "short", 0.0), (None, None, "no id", 0.0)]
    folder = shared_path(spark, "warc-ids")
    manifest = warc.write_archives(spark.createDataFrame(rows, PAGES), folder)
    store, root = fs.FileSystem.from_uri(folder)
    fields = []
    for name in (r.path for r in manifest.collect()):
        with store.open_input_stream(f"{root}/{name}") as f:
            for record in warc.decode_archive(f.read()):
                fields.append(dict(line.split(": ", 1) for line in record.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:]))
    ids = {f["WARC-Record-ID"]: f for f in fields}
    assert len(ids) == len(rows) and all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", f["WARC-Date"]) for f in fields)
    revisits = [f for f in fields if f["WARC-Type"] == "revisit"]
    assert len(revisits) == 7
    for f in revisits:
        target = ids[f["WARC-Refers-To"]]
        assert target["WARC-Type"] == "response" and target["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]


def test_warc_round_trip_and_revisits(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    big, other = "<p>x</p>" * 400, "é\r\n\r\nWARC/1.1\r\n" * 300
    rows = [(i, f"http://h/{i}", big, 0.0) for i in range(1, 40)] + [(50, None, other, 0.0), (51, "a\r\nb", other, 0.0), (60, "u", "short", 0.0), (61, "u", "short", 0.0),
            (70, "u", None, 0.0), (None, "u", "no id", 0.0), (80, "u", "z" * 100_000, 0.0)]
    folder = shared_path(spark, "warc-test")
    manifest = warc.write_archives(spark.createDataFrame(rows, PAGES), folder)
    got = {r.page_id: r for r in warc.read_archives(spark, folder, manifest).collect()}
    assert len(got) == len(rows) and manifest.agg({"records": "sum"}).first()[0] == len(rows)
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        best = max((j for j, _, h, _ in rows if h == html and j is not None), default=None)
        revisit = len(raw) >= 1000 and best != i
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", best) if revisit else ("response", None))
        assert bytes(r.payload) == (b"" if revisit else raw)
    none = shared_path(spark, "warc-none")
    assert warc.read_archives(spark, none, warc.write_archives(spark.createDataFrame([], PAGES), none)).collect() == []


def test_queries_of_all_operators():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert all(f.__doc__ for f in QUERIES.values()) and set(ORACLES) <= set(QUERIES)
