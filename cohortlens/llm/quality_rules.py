"""Quality rules: statistics of each text, fixed base rules, and boosted trees.

The trees learn ``quality`` from statistics of labelled documents; their score
may only fall with the shares of symbols, repeated lines and repeated words.

Defined cases: null or empty text has no words, all counts 0, and fails the
base rules; repeated rows are scored each; null doc_id is kept; an empty table
gives no rows; without labels every document past the base rules is kept;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm.boosting import Forest, train
from cohortlens.llm.labels import training_rows
from cohortlens.llm.registry import register
from cohortlens.llm.tables import read
from cohortlens.llm.words import SPACES, Hasher, chunks, mix, scan, shingles

#: Most labelled documents that the trees learn from.
TRAINING_ROWS = 20_000
THRESHOLD = 0.5
FEATURES = ["log_words", "word_length", "symbol_share", "dup_line_share", "repeat_word_share", "upper_share", "digit_share",
            "stop_share", "shout_share", "lone_symbol_share", "distinct_share", "lines_per_word", "other_script_share", "same_as_last_share"]
MONOTONE = {FEATURES.index(f): -1 for f in ("symbol_share", "dup_line_share", "repeat_word_share")}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _bytes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _bytes(b"#*$%&|<>")
_DIGIT, _UPPER, _STOP, _SHOUT = _bytes(b"0123456789"), _bytes(bytes(range(65, 91))), _bytes(b".,;:?"), _bytes(b"!")


def _dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line; lines with a word."""
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line.strip(SPACES):
            n += 1
            seen.add(line)
    return n - len(seen), n


def statistics(texts: list[bytes], hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Counts (rows, COUNTS) and features (rows, FEATURES) of one chunk."""
    words = scan(texts)
    n_docs, n = len(texts), np.diff(words.first)

    def per_text(of_byte: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(of_byte)])
        return np.diff(sums[words.begin])

    def per_word(of_word: np.ndarray) -> np.ndarray:
        return np.bincount(words.doc[of_word], minlength=n_docs)

    sums = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    chars = np.bincount(words.doc, weights=sums[words.ends] - sums[words.starts], minlength=n_docs).astype(np.int64)
    h = words.hashes(hasher)
    runs, owner = shingles(words, h, 3)
    full = n[owner] >= 3  # texts of fewer words have no window of three
    runs, owner = runs[full], owner[full]
    _, back, times = np.unique(runs ^ mix(owner.astype(np.uint64)), return_inverse=True, return_counts=True)
    covered = np.zeros(len(h) + 2, bool)
    begins = np.flatnonzero(words.doc[:-2] == words.doc[2:]) if len(h) > 2 else np.zeros(0, int)
    again = begins[times[back] > 1]
    for j in range(3):
        covered[again + j] = True
    repeats = per_word(covered[:len(h)])
    lines = np.array([_dup_lines(t) for t in texts], np.int64).reshape(-1, 2)
    counts = np.stack([n, chars, per_text(_SYMBOL[words.data]), lines[:, 0], repeats], axis=1).astype(np.int64)
    distinct = np.unique(np.stack([words.doc.astype(np.uint64), h]), axis=1)[0].astype(np.int64) if len(h) else np.zeros(0, np.int64)
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    lone = (words.ends - words.starts == 1) & _SYMBOL[words.data[words.starts]] if len(h) else np.zeros(0, bool)
    c, w = np.maximum(chars, 1), np.maximum(n, 1)
    features = np.stack([
        np.log1p(n), chars / w, counts[:, 2] / c, lines[:, 0] / np.maximum(lines[:, 1], 1), repeats / w, per_text(_UPPER[words.data]) / c,
        per_text(_DIGIT[words.data]) / c, per_text(_STOP[words.data]) / w, per_text(_SHOUT[words.data]) / w, per_word(lone) / w,
        np.bincount(distinct, minlength=n_docs) / w, lines[:, 1] / w, per_text(words.data >= 0x80) / c, per_word(same) / w], axis=1)
    return counts, features


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> Forest:
    """Trees on the statistics of labelled documents."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for at, part in chunks(batch.column(1).cast(pa.binary()).to_pylist()):
                f = statistics(part, hasher)[1]
                y = batch.column(2).slice(at, len(part))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), y, *[pa.array(f[:, j]) for j in range(f.shape[1])]], ["doc_id", "label", *FEATURES])

    schema = "doc_id bigint, label int, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = training_rows(docs, labels, "quality", most).mapInArrow(measure, schema).toPandas().sort_values(["doc_id", *FEATURES])
    return train(rows[FEATURES].to_numpy(), rows["label"].to_numpy().astype(float), MONOTONE)


def judge(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed, score, kept."""
    fields = ["doc_id", *COUNTS, "base_failed", "score", "kept"]
    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for at, part in chunks([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]):
                counts, features = statistics(part, hasher)
                failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
                score = forest.score(features)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *[pa.array(counts[:, j]) for j in range(len(COUNTS))],
                                                  pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))], fields)

    return docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "CAST(text AS string) AS text").mapInArrow(apply, schema)


@register("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, the base rules and the verdict of the trees."""
    docs = read(spark, sf_dir, "documents")
    return judge(docs, fit(docs, read(spark, sf_dir, "labels")))
