"""The pipeline's stages keep their contracts, each on the output of the one before."""

import collections

import pytest
from edge import WORD, frame
from test_sets import brute_classes, brute_lines
from test_texts import toxic_corpus

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "source_mixing", "best_fit_packing"]


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    rows = [(i, t, f"s{i % 3}") for i, t, _ in toxic_corpus(300)]
    rows += [(1000 + i, t, s) for i, t, s in rows[1:40]] + [(2000, None, None), (2001, "", "s1")]
    near = rows[2][1].split()
    rows.append((3000, " ".join(near[:-1] + ["changed"] + near[-1:]), "s2"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i, _, _ in rows if i < 300], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs]
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, seen[-1], str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
    texts = [[(r.doc_id, r.text) for r in d.collect()] for d in seen[:5]]
    assert all(d.columns == docs.columns for d in seen[:5])
    toxic = {i for i, _, _ in rows if i % 1000 % 5 == 0 and i < 2000}
    assert {i for i, _ in texts[1]} == {i for i, _, _ in rows} - toxic
    want = {i: t for i, t in brute_lines(texts[1]) if t is None or WORD.search(t) or not WORD.search(dict(texts[1])[i])}
    assert dict(texts[2]) == want
    assert {i for i, _ in texts[3]} == {i for i, _, c in brute_classes(texts[2], 5, 8, 10) if i == c}
    size, taken = collections.Counter(), collections.Counter()
    for i, t in texts[3]:
        size[i] += len(WORD.findall(t or ""))
    for i, t in texts[4]:
        taken[i] += len(WORD.findall(t))
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 3 and all(taken[i] <= 2 * size[i] for i in taken)
    packed = seen[5].collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == collections.Counter(i for i, _ in texts[4])
    assert all(r.offset + r.length <= 1024 and len(r.ids) == r.length for r in packed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_pipeline_with_nulls_repeats_and_a_long_text(spark, tmp_path):
    rows = [(i, t, f"s{i % 2}") for i, t, _ in toxic_corpus(300)]
    long = " ".join(f"long{i * 7919 % 9973}x" for i in range(60_000))
    rows += [(None, "a line of a document without any id at all", None), (None, "another line of a text that has no id", "s1"), (None, None, "s0"),
             rows[7], rows[7], (900, long, "s1"), (901, "", None), (902, " \n\t", "s0"), (903, "only one", None)]
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)] + [(None, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = []
    for name, step in corpus_pipeline.STAGES:
        step(spark, stages[-1] if stages else docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        stages.append(spark.read.parquet(f"{tmp_path}/{name}"))
    counts = [collections.Counter(r.doc_id for r in d.collect()) for d in stages[:4]]
    assert counts[0][7] == counts[1][7] == counts[2][7] == 3 and counts[0][None] == counts[2][None] == 3
    assert counts[2][900] == 1 and not set(counts[2]) & {i for i in range(0, 300, 5)}
    mixed = stages[3].collect()
    assert all(WORD.search(r.text or "") for r in mixed) and {r.doc_id for r in mixed} >= {None, 900}
    assert {r.doc_id for r in stages[4].collect()} == {r.doc_id for r in mixed}


@pytest.mark.parametrize("labelled", [True, False])
def test_pipeline_without_documents(spark, tmp_path, labelled):
    spark.createDataFrame([(i, 1, i % 2) for i in range(9 * labelled)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
