"""SimHash fingerprints and the search for near ones in permuted block tables.

Each word occurrence votes with its weight, the inverse document frequency of
its hash counter, for or against each of 64 bits by the bits of the word's
hash; the signs of the sums are the fingerprint.  Counters cover all documents
(2**RARITY_BITS numbers whatever their size).

To find all fingerprints within Hamming distance r, the 64 bits are cut into
more blocks than r; fingerprints at most r bits apart agree in all bits of some
choice of ``blocks - r`` of them.  For each choice one table is keyed by these
blocks, so near fingerprints meet in one of them and are then counted exactly.

Defined cases: null text is empty; texts without words have the fingerprint 0;
equal texts have equal fingerprints; rows that repeat a doc_id all stay, in the
order of their texts' hashes, each next to the other; a null doc_id stands after
the last; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.registry import register
from cohortlens.llm.tables import read, stage
from cohortlens.llm.words import Hasher, chunks, scan

BITS = 64
RADIUS = 3
BLOCKS = 6
RARITY_BITS = 16


def document_counts(docs: DataFrame, bits: int = RARITY_BITS) -> tuple[np.ndarray, int]:
    """In how many documents each word counter occurs, over all; and their number."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total, n = Hasher(), np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, part in chunks([t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]):
                words = scan(part)
                counter = (words.hashes(hasher) >> np.uint64(64 - bits)).astype(np.int64)
                each = np.unique((words.doc << bits) | counter) & ((1 << bits) - 1)
                total += np.bincount(each, minlength=1 << bits)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], n))], ["counter", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((1 << bits) + 1, np.int64)
    out[rows["counter"].to_numpy()] = rows["n"].to_numpy()
    return out[:-1], int(out[-1])


def weights(counts: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequencies; 0 for a word of every document."""
    return np.log((n + 1.0) / (np.minimum(counts, n) + 1.0)).astype(np.float32)


def fingerprints(texts: list[bytes], weight: np.ndarray, hasher: Hasher) -> np.ndarray:
    """Fingerprints (uint64) of ``texts``."""
    bits = int(len(weight)).bit_length() - 1
    out = np.zeros(len(texts), np.uint64)
    for at, part in chunks(texts):
        words = scan(part)
        h = words.hashes(hasher)
        w = weight[(h >> np.uint64(64 - bits)).astype(np.int64)]
        for i in range(len(part)):
            a, b = words.first[i], words.first[i + 1]
            if a < b:
                # a vote of +1 or -1 for each bit: twice the weight of the set bits less the whole
                ones = w[a:b] @ np.unpackbits(h[a:b].view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
                out[at + i] = np.packbits(2 * ones > w[a:b].sum()).view(np.uint64)[0]
    return out


def edit(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the next document's begin."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k] if k else text


ROW = "doc_id bigint, n_chars bigint, edited_sha256 string, fp bigint, edited_fp bigint, next_fp bigint"


def _signed_rows(ids: list, texts: list[str], following: list[str], weight: np.ndarray, hasher: Hasher) -> list[tuple]:
    """ROW of each of consecutive texts, with the one that follows each."""
    fp = fingerprints([t.encode() for t in texts], weight, hasher)
    after = fingerprints([following[-1].encode()], weight, hasher)
    edited = [edit(t, f).encode() for t, f in zip(texts, following)]
    efp = fingerprints(edited, weight, hasher)
    nxt = np.append(fp[1:], after).view(np.int64).tolist()
    sha = [hashlib.sha256(e).hexdigest() for e in edited]
    return list(zip(ids, map(len, texts), sha, fp.view(np.int64).tolist(), efp.view(np.int64).tolist(), nxt))


def sign(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fp, edited_fp and next_fp (64 bits each as bigint).

    Texts are dealt once by ranges of (doc_id, hash), so the next row of almost
    every row follows it in its partition; the first and the last rows of the
    partitions, two for each, are paired afterwards.
    """
    spark = docs.sparkSession
    weight = weights(*document_counts(docs))
    sent = spark.sparkContext.broadcast(weight)
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
    names = ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp", "part", "first", "text"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hasher, part, held = Hasher(), TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if held is None:
                yield batch_of([(ids[0], None, None, None, None, None, part, True, texts[0])])
            else:
                ids.insert(0, held[0])
                texts.insert(0, held[1])
            held = ids[-1], texts[-1]
            for a in range(0, len(ids) - 1, 1000):
                b = min(a + 1000, len(ids) - 1)
                rows = _signed_rows(ids[a:b], texts[a:b], texts[a + 1:b + 1], sent.value, hasher)
                yield batch_of([(*r, None, None, None) for r in rows])
        if held is not None:
            yield batch_of([(held[0], None, None, None, None, None, part, False, held[1])])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = ROW + ", part int, first boolean, text string"
    found = stage(own.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(work, schema), "simhash-rows")
    edges = found.filter("part IS NOT NULL")
    ends = edges.filter("NOT first").select("part", "doc_id", "text")
    begins = edges.filter("first").select(F.col("part").alias("p"), F.col("text").alias("head"))
    # two rows for each partition that has rows, whatever the input
    following = (begins.select("p").withColumn("before", F.coalesce(F.lag("p").over(Window.orderBy("p")), F.max("p").over(Window.partitionBy()))))
    paired = ends.join(following, F.col("part") == F.col("before")).join(begins, "p").select("doc_id", "text", "head")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for i, t, head in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(_signed_rows([i], [t], [head], sent.value, hasher)[0], types)], names[:6])

    columns = [f.split()[0] for f in ROW.split(", ")]
    return found.filter("part IS NULL").select(*columns).unionByName(paired.mapInArrow(close, ROW))


def near_fingerprints(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs (a, b), a < b, of different fingerprints (column ``fp``) at most ``radius`` bits apart."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("need 0 <= radius < blocks <= 64")
    different = fps.select("fp").distinct()
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    part = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    masks = [sum(c) for c in itertools.combinations(part, blocks - radius)]
    signed = [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("k")) for i, m in enumerate(signed)]))
    keyed = different.select("fp", tables.alias("x")).select("x.t", "x.k", "fp")
    x, y = keyed.alias("x"), keyed.alias("y")
    near = F.expr(f"x.fp < y.fp AND bit_count(x.fp ^ y.fp) <= {radius}")
    return x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("x.k") == F.col("y.k")) & near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()


@register("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, their likeness, that
    to the next document, and how many other fingerprints are within the radius."""
    signed = stage(sign(read(spark, sf_dir, "documents")), "fingerprints")
    pairs = near_fingerprints(signed)
    both = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp")))
    near = both.groupBy("fp").agg(F.count(F.lit(1)).alias("n_near"))
    like = lambda a, b: 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(float(BITS))
    name = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return (signed.join(near, "fp", "left")
            .select("doc_id", "n_chars", "edited_sha256", name("fp").alias("fingerprint"), name("edited_fp").alias("edited_fingerprint"),
                    like("fp", "edited_fp").alias("near_edited"), like("fp", "next_fp").alias("near_next"),
                    F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near")))
