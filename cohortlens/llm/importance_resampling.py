"""Importance resampling of documents towards a target set of texts.

Words come from the pre-tokeniser of ``tokenizers``: an untrained ``Split`` by a
regular expression over text whose A-Z are lower-cased.  It gives each word with
its offsets; the words of a text are laid out with one space between, so that a
feature (one to three consecutive words) is a window between the offsets of its
first and last word.  A feature's bucket is the CRC-32 of its bytes modulo the
number of buckets; two histograms over all texts, of the corpus and of the
target, give each bucket a gain, and a text weighs the sum of its gains.  The
draw takes the highest weights plus Gumbel noise that depends on the id alone.

A window's CRC is combined from those of its words: CRC-32 is linear, so that of
two parts follows from theirs and the length of the second.  Histograms have a
fixed number of buckets, so gains are broadcast; texts stay in their task, and
their buckets (two bytes each) are written once for the histogram and the sums.

Defined cases: null and empty texts have no features and weigh 0; a null id
draws its noise from the empty id; repeated rows are documents of their own
(equal weight and score, consecutive ranks); an empty table gives no rows, an
empty target gains that depend on the corpus alone; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.registry import register
from cohortlens.llm.tables import read, stage
from cohortlens.operators.ranking import positions

BUCKETS = 10_000
LONGEST_RUN = 3
LEAST_WORDS = 20
SHARE = (5, 100)
SEED = 42
#: A word, as the contract names its characters.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Characters that the pre-tokeniser gets at once; a longer text is cut between words.
SLICE = 1 << 16
#: Words up to so many bytes are combined by table, longer ones read byte by byte.
TABLED = 64

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _zero_bytes(longest: int) -> np.ndarray:
    """``[n, k, b]``: the CRC register that holds ``b`` in byte ``k``, after ``n`` zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> np.uint32(1)) ^ np.uint32(0xEDB88320), one >> np.uint32(1))
    out = np.empty((longest + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for n in range(longest):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ one[out[n] & np.uint32(0xFF)]
    return out


class Features:
    """Buckets of all word runs of a text; one object serves a task."""

    def __init__(self, buckets: int = BUCKETS) -> None:
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True).pre_tokenize_str
        self.after = _zero_bytes(TABLED)
        self.buckets = np.uint32(buckets)

    def words(self, text: str) -> list[bytes]:
        """Words of one lower-cased text, in slices that end between words."""
        out: list[bytes] = []
        at = 0
        while at < len(text):
            end = at + SLICE
            while end < len(text) and (text[end].isascii() is False or text[end].isalnum()):
                end += 1  # inside a word, perhaps
            out += [w.encode() for w, _ in self.split(text[at:end])]
            at = end
        return out

    def combined(self, first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRCs of joined parts: the first one moved over the second's bytes, then both added."""
        a, n = self.after, length
        return (a[n, 0, first & 0xFF] ^ a[n, 1, first >> 8 & 0xFF] ^ a[n, 2, first >> 16 & 0xFF] ^ a[n, 3, first >> 24]) ^ second

    def of(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of words, and the buckets of their runs: single words first, then pairs, then triples."""
        words = self.words((text or "").encode().translate(_LOWER).decode())
        n = len(words)
        if not n:
            return 0, np.zeros(0, np.uint16)
        joined = b" ".join(words)
        length = np.fromiter(map(len, words), np.int64, n)
        start = np.cumsum(length + 1) - length - 1
        single = np.fromiter(map(zlib.crc32, words), np.uint32, n)
        runs = [single]
        space = np.full(n, zlib.crc32(b" "), np.uint32)
        short = np.minimum(length, TABLED)
        for k in range(2, LONGEST_RUN + 1):
            if n < k:
                break
            head = self.combined(runs[-1][:n - k + 1], space[:n - k + 1], np.ones(n - k + 1, np.int64))
            crc = self.combined(head, single[k - 1:], short[k - 1:])
            for i in np.flatnonzero(length[k - 1:] > TABLED).tolist():
                crc[i] = zlib.crc32(joined[start[i]:start[i + k - 1] + length[i + k - 1]])
            runs.append(crc)
        return n, (np.concatenate(runs) % self.buckets).astype(np.uint16)


def bucketed(texts: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """(key, n_words, n_features, buckets): the features of each text as little-endian 16-bit buckets."""
    if buckets > 1 << 16:
        raise ValueError("a bucket has 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                found = [features.of(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([len(b) for _, b in found], pa.int64()),
                     pa.array([b.astype("<u2").tobytes() for _, b in found], pa.binary())],
                    [key, "n_words", "n_features", "buckets"])

    return (texts.select(F.col(f"`{key}`").cast("bigint").alias(key), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, f"`{key}` bigint, n_words bigint, n_features bigint, buckets binary"))


def histogram(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket: each task counts its own, then a sum over tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(value, "<u2"), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in (features.select("buckets").mapInArrow(count, "bucket bigint, n bigint")
              .groupBy("bucket").agg(F.sum("n").alias("n")).collect()):  # `buckets` rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + B) / ((s + 1) (T + B)))) of each of the B buckets, in doubles."""
    b, big_s, big_t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (big_s + b) / ((s + 1.0) * (big_t + b))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighed(features: DataFrame, gain: np.ndarray, key: str) -> DataFrame:
    """(key, n_words, n_features, weight): the sum of the gains of a text's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(gain[np.frombuffer(v, "<u2")].sum()) for v in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], [key, "n_words", "n_features", "weight"])

    return features.mapInArrow(run, f"`{key}` bigint, n_words bigint, n_features bigint, weight bigint")


def noise(key: str, seed: int = SEED) -> F.Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h the first 32 bits of sha256(`seed:id`)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", target_key: str = "item_id",
             share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED,
             buckets: int = BUCKETS) -> DataFrame:
    """Every document: key, n_words, n_features, weight, score and its rank in the draw (null: not drawn).

    Drawn are floor(share x N) of the N documents with at least ``least_words``
    words, by score, ties to the smaller id.
    """
    features = stage(bucketed(docs, key, buckets), "features")
    gain = gains(histogram(features, buckets), histogram(bucketed(target, target_key, buckets), buckets))
    scored = stage(weighed(features, gain, key).withColumn("score", F.col("weight") + noise(key, seed)), "weights")
    enough = F.col("n_words") >= least_words
    n = scored.filter(enough).count()
    placed = positions(scored, [(~enough).cast("int"), -F.col("score"), F.col(key)])
    drawn = enough & (F.col("position") < n * share[0] // share[1])
    return placed.select(key, "n_words", "n_features", "weight", "score", F.when(drawn, F.col("position") + 1).alias("rank"))


@register("op13_importance_resampling")
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents resampled towards the benchmark's texts: features, weight, score and rank of each."""
    return (resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
            .select("doc_id", "n_features", "weight", "score", "rank"))
