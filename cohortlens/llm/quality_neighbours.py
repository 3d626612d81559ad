"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A document is a vector of terms: byte trigrams (hashed) and word shapes (case,
symbols, end mark, length, whether the word repeats), each the square root of
its share times the inverse document frequency over all documents.  A truncated
singular value decomposition of the labelled documents' vectors gives the
latent space.  Every document's cosine with every labelled vector is computed,
in blocks, and its nearest neighbours vote with their similarity.

The labelled vectors are bounded (``TRAINING_ROWS`` x ``RANK`` numbers), so they
can be sent to all executors.

Defined cases: null or empty text has no terms and gets the share of label 1;
without labels every score is 0.5; repeated rows are scored each; null doc_id
is kept (not held out); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.labels import held_out, training_rows
from cohortlens.llm.registry import register
from cohortlens.llm.tables import read
from cohortlens.llm.words import Hasher, chunks, mix, scan

#: Most labelled documents that vote.
TRAINING_ROWS = 6_000
RANK = 64
NEIGHBOURS = 15
THRESHOLD = 0.3
TRIGRAMS, SHAPES = 2048, 256
TERMS = TRIGRAMS + SHAPES
#: Documents whose cosines are computed at once, and whose terms are counted at once.
BLOCK, CHUNK_ROWS = 512, 1024

_MARK = np.zeros(256, bool)
_MARK[list(b"#*$%&|<>!@^~_=+{}[]")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:?!")] = True


def term_counts(texts: list[bytes], hasher: Hasher) -> np.ndarray:
    """(texts, TERMS) counts of one chunk."""
    words = scan(texts)
    n, data = len(texts), words.data
    b = data.astype(np.uint32)
    code = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(21)
    sizes = np.diff(words.begin) - 1  # without the separator
    owner = np.repeat(np.arange(n), np.maximum(sizes - 2, 0))
    starts = np.repeat(words.begin[:-1] - np.cumsum(np.maximum(sizes - 2, 0)) + np.maximum(sizes - 2, 0), np.maximum(sizes - 2, 0)) + np.arange(len(owner))
    grams = np.bincount(owner * TRIGRAMS + code[starts], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    if not len(words.starts):
        return np.hstack([grams, np.zeros((n, SHAPES), grams.dtype)])
    s, e = words.starts, words.ends
    marks = np.concatenate([[0], np.cumsum(_MARK[data])])
    upper = (data >= 65) & (data <= 90)
    h = words.hashes(hasher)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    _, back, times = np.unique(h ^ mix(words.doc.astype(np.uint64)), return_inverse=True, return_counts=True)
    length = np.digitize(e - s, [3, 6, 10])
    often = times[back] * 10 > np.diff(words.first)[words.doc]  # a tenth of the text's words
    shape = (upper[s].astype(np.int64) | upper[np.minimum(s + 1, e - 1)] * 2 | (marks[e] > marks[s]) * 4 | _STOP[data[e - 1]] * 8 | same * 16 | often * 32 | length * 64)
    shapes = np.bincount(words.doc * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES)
    return np.hstack([grams, shapes])


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted terms, trigrams and shapes each of length 1."""
    x = np.sqrt(counts, dtype=np.float32) * idf
    for part in (x[:, :TRIGRAMS], x[:, TRIGRAMS:]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return x


def inverse_document_frequency(docs: DataFrame) -> np.ndarray:
    """Of each term, over all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total, n = Hasher(), np.zeros(TERMS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, part in chunks([t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()], most=CHUNK_ROWS):
                total += (term_counts(part, hasher) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, TERMS)), pa.array(np.append(n, total))], ["term", "n"])

    out = np.zeros(TERMS + 1)
    for term, n in docs.select(F.col("text").cast("string")).mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return np.log((out[-1] + 1) / (out[:-1] + 1)).astype(np.float32) + np.float32(0.1)


class Space(NamedTuple):
    idf: np.ndarray
    axes: np.ndarray  # (TERMS, rank)
    vectors: np.ndarray  # (labelled, rank), of length 1
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        z = _vectors(counts, self.idf) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the neighbours, by similarity."""
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        out = np.full(len(counts), prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(counts), BLOCK):
            part = counts[a:a + BLOCK]
            cosine = self.project(part) @ self.vectors.T
            nearest = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, nearest, axis=1), 0.0).astype(np.float64) ** 4 + 1e-12
            votes = (weight * self.labels[nearest]).sum(axis=1) / weight.sum(axis=1)
            out[a:a + BLOCK] = np.where(part.sum(axis=1) > 0, votes, prior)
        return np.clip(out, 0.0, 1.0)


def decompose(x: np.ndarray, rank: int, rounds: int = 4) -> np.ndarray:
    """The first right singular vectors of ``x``, by randomised subspace iteration."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(1).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :rank]


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> Space:
    idf = inverse_document_frequency(docs)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for at, part in chunks(batch.column(1).cast(pa.binary()).to_pylist(), 1 << 20, CHUNK_ROWS):
                x = _vectors(term_counts(part, hasher), idf).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(2).slice(at, len(part)), pa.array([v.tobytes() for v in x], pa.binary())],
                                                 ["doc_id", "label", "vector"])

    rows = training_rows(docs, labels, "quality", most).mapInArrow(measure, "doc_id bigint, label int, vector binary").toPandas().sort_values(["doc_id", "vector"])
    if not len(rows):
        return Space(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    x = np.frombuffer(b"".join(rows["vector"]), np.float16).reshape(-1, TERMS).astype(np.float32)
    axes = decompose(x, RANK)
    z = x @ axes
    return Space(idf, axes, z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9), rows["label"].to_numpy().astype(float))


def classify(docs: DataFrame, space: Space) -> DataFrame:
    """doc_id, score of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(space))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, own = Hasher(), Space(*sent.value)
        for batch in batches:
            for at, part in chunks([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()], 1 << 20, CHUNK_ROWS):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(own.score(term_counts(part, hasher)))], ["doc_id", "score"])

    return docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "CAST(text AS string) AS text").mapInArrow(apply, "doc_id bigint, score double")


@register("op9_quality_neighbours")
def op9_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = read(spark, sf_dir, "documents")
    rows = classify(docs, fit(docs, read(spark, sf_dir, "labels")))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
