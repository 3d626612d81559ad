"""Sequences of lexically related documents, by retrieval from a sharded BM25 index.

A document is its token ids plus an end id.  Its full blocks of ``capacity`` ids
are sequences by themselves; what is left of it, less than a sequence, is packed
with its neighbours.  The rests are dealt to shards of about ``SHARD_TOKENS``
ids by their most telling word, so that related ones come together, and every
shard has an inverted index of its rests' words (of the whole documents),
weighted by BM25 with frequencies and lengths counted over all documents.  In
turn, a seed - what the last window has cut off, else the longest rest not yet
used - asks the index for unused neighbours, and they fill its window greedily,
best first: whole ones while one fits that scores at least ``NEAR`` of the best one
left, then the best is cut to the space that remains.  So all windows are full but a shard's last, which is cut into
powers of two, lengths that need no padding.

A shard is planned from a histogram of tokens over a fixed number of keys: small
keys share a shard, a key beyond one is dealt over several by row number, so its
size does not depend on how often a word, or a document, repeats.

Defined cases: null or empty text is the end id alone; documents without words
have no neighbours and fill windows by length; repeated rows are packed once
each; null ``doc_id`` is kept; equal scores go by row number; an empty table gives
no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.best_fit_packing import VOCABULARY, task_encoder
from cohortlens.llm.registry import register
from cohortlens.llm.tables import read, stage
from cohortlens.llm.words import Hasher, chunks, scan

CAPACITY = 1024
END_ID = 0
#: Token ids of the rests in one shard, about.
SHARD_TOKENS = 1 << 18
#: Counters of document frequencies, and keys of the plan of shards, in bits of a word's hash.
COUNTER_BITS = 18
KEY_BITS = 16
#: A word in fewer documents brings none together, so it is no key.
LEAST_SHARED = 4
#: A neighbour that fits whole goes before a better one that has to be cut, down to this share of its score.
NEAR = 0.5
#: The usual parameters of BM25.
K1, B = 1.2, 0.75

PIECES = ("row bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary, "
          "n_words bigint, terms binary, counts binary")
PACKED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def _terms(texts: list[bytes], hasher: Hasher) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each text: its number of words, their 32-bit hashes, each once, and how often each occurs."""
    words = scan(texts, lower=True)
    term = words.hashes(hasher) >> np.uint64(32)
    both, count = np.unique(words.doc.astype(np.uint64) << np.uint64(32) | term, return_counts=True)
    at = np.searchsorted(both, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    n = np.diff(words.first)
    return [(int(n[i]), both[a:b].astype(np.uint32), count[a:b].astype(np.uint32)) for i, (a, b) in enumerate(zip(at, at[1:]))]


def blocks(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY,
           with_ids: bool = True) -> DataFrame:
    """Full blocks of every document and its rest, with the words of the whole
    document on the last of them (the only one with ``terms``).  Without
    ``with_ids`` only rests, which may be cut yet, carry their ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hasher, row = Hasher(), TaskContext.get().partitionId() << 36
        with task_encoder(vocabulary) as encoder:
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
                for at, part in chunks(texts):
                    rows: list[tuple] = []
                    for i, (x, (n, terms, counts)) in enumerate(zip(encoder.encode(part), _terms(part, hasher))):
                        x = np.append(x, np.uint32(end_id)).astype("<u4")
                        for a in range(0, len(x), capacity):
                            raw, last = x[a:a + capacity].tobytes(), a + capacity >= len(x)
                            rows.append((row, doc_ids[at + i], a, len(raw) // 4, zlib.crc32(raw), len(x), raw if with_ids or len(raw) < 4 * capacity else None,
                                         n if last else None, terms.tobytes() if last else None, counts.tobytes() if last else None))
                            row += 1
                    kinds = [pa.int64()] * 6 + [pa.binary(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                     ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "n_words", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def statistics(pieces: DataFrame, bits: int = COUNTER_BITS) -> tuple[np.ndarray, int, int]:
    """Documents that hold each word counter, documents and words, over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, words = np.zeros(1 << bits, np.int64), 0, 0
        for batch in batches:
            n += batch.num_rows
            words += sum(batch.column(0).to_pylist())
            # words of one document that share a counter count once each: the counter stands for both
            terms = np.concatenate([np.frombuffer(t, "<u4") for t in batch.column(1).to_pylist()] or [np.zeros(0, "<u4")])
            total += np.bincount(terms >> np.uint32(32 - bits), minlength=1 << bits)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, [-1, -2])), pa.array(np.append(total[used], [n, words]))], ["counter", "n"])

    rows = (pieces.filter("terms is not null").select("n_words", "terms").mapInArrow(run, "counter bigint, n bigint")
            .groupBy("counter").agg(F.sum("n").alias("n")).toPandas())  # 2^bits rows and two
    out = np.zeros((1 << bits) + 2, np.int64)
    out[rows["counter"].to_numpy()] = rows["n"].to_numpy()
    return out[:-2], int(out[-1]), int(out[-2])


def idf(counts: np.ndarray, n: int) -> np.ndarray:
    """ln((N - n + 0.5) / (n + 0.5)), 0 for words of more than half of the documents."""
    held = np.minimum(counts, n)
    return np.maximum(np.log((n - held + 0.5) / (held + 0.5)), 0).astype(np.float32)


def keyed(rests: DataFrame, counts: np.ndarray, weight: np.ndarray, key_bits: int = KEY_BITS) -> DataFrame:
    """The rests with ``key``: the leading bits of the most telling word that other documents share."""
    bits = len(weight).bit_length() - 1
    sent = rests.sparkSession.sparkContext.broadcast((counts, weight))  # 2^bits numbers each

    @F.arrow_udf("int")
    def key(terms: pa.Array, counts: pa.Array) -> pa.Array:
        held, value = sent.value
        keys = []
        for t, c in zip(terms.to_pylist(), counts.to_pylist()):
            term, tf = np.frombuffer(t, "<u4"), np.frombuffer(c, "<u4")
            at = term >> np.uint32(32 - bits)
            telling = value[at] * (tf / (tf + np.float32(K1))) * (held[at] >= LEAST_SHARED)
            keys.append(int(term[telling.argmax()] >> np.uint32(32 - key_bits)) if len(term) else 0)
        return pa.array(keys, pa.int32())

    # only the words go to Python; as a deterministic function it would run again for the filter that a join on keys brings
    return rests.withColumn("key", key.asNondeterministic()("terms", "counts"))


def shard_plan(tokens: dict[int, int], shard_tokens: int) -> list[tuple[int, int, int]]:
    """(key, first shard, number of shards): consecutive keys share a shard, a large key has several."""
    out, shard, filled = [], 0, 0
    for key in sorted(tokens):
        n = -(-tokens[key] // shard_tokens)
        if n > 1:
            shard += bool(filled)
            out.append((key, shard, n))
            shard, filled = shard + n, 0
            continue
        if filled and filled + tokens[key] > shard_tokens:
            shard, filled = shard + 1, 0
        out.append((key, shard, 1))
        filled += tokens[key]
    return out


class Index:
    """Inverted BM25 index of one shard's rests."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], n_words: np.ndarray, weight: np.ndarray, mean_words: float) -> None:
        bits = len(weight).bit_length() - 1
        size = np.array([len(t) for t in terms], np.int64)
        term = np.concatenate(terms) if len(terms) else np.zeros(0, np.uint32)
        tf = (np.concatenate(counts) if len(counts) else np.zeros(0, np.uint32)).astype(np.float64)
        doc = np.repeat(np.arange(len(terms)), size)
        value = weight[term >> np.uint32(32 - bits)] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (n_words / max(mean_words, 1e-9))[doc]))
        told = value > 0
        term, doc, value = term[told], doc[told], value[told]
        order = np.argsort(term, kind="stable")
        lists, at, size = np.unique(term[order], return_index=True, return_counts=True)
        self.n, self.doc, self.value, self.at, self.size = len(terms), doc[order], value[order], at, size
        self.own = np.searchsorted(lists, term)  # list of each posting, by document
        self.first = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(terms)))])

    def scores(self, document: int) -> np.ndarray:
        """BM25 score of every rest for the words of ``document``."""
        lists = self.own[self.first[document]:self.first[document + 1]]
        size = self.size[lists]
        if not len(size):
            return np.zeros(self.n)
        ends = np.cumsum(size)
        posting = np.repeat(self.at[lists] - ends + size, size) + np.arange(ends[-1])
        return np.bincount(self.doc[posting], self.value[posting], self.n)


def fill(index: Index, length: np.ndarray, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (rest, from, to): every id of every rest once; all windows full but the last."""
    left, begin = length.copy(), np.zeros(len(length), np.int64)
    by_length = iter(np.argsort(-length, kind="stable").tolist())
    windows: list[list[tuple[int, int, int]]] = []
    seed, unused = None, len(length)
    while unused:
        if seed is None:
            seed = next(i for i in by_length if left[i])
        score = index.scores(seed)
        others = np.flatnonzero(left)
        others = others[others != seed]
        others = others[np.argsort(-score[others], kind="stable")]
        falling, size = -score[others], left[others]
        window, space, i, head = [], capacity, seed, 0
        seed = None
        while True:
            taken = int(min(left[i], space))
            window.append((i, int(begin[i]), int(begin[i]) + taken))
            begin[i] += taken
            left[i] -= taken
            space -= taken
            unused -= not left[i]
            while head < len(others) and size[head] > capacity:  # taken
                head += 1
            if not space or head == len(others):
                break
            near = size[head:np.searchsorted(falling, NEAR * falling[head], "right")] <= space
            best = head + int(near.argmax())
            if size[best] > space:
                best = head  # the best neighbour is cut, and its rest begins the next window
                seed = int(others[best])
            i = int(others[best])
            size[best] = capacity + 1
        windows.append(window)
    return windows


def powers(window: list[tuple[int, int, int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """A window as sequences whose lengths are powers of two; a full one as it is."""
    total = sum(b - a for _, a, b in window)
    if total == capacity:
        return [window]
    out, parts = [], list(reversed(window))
    for bit in range(total.bit_length() - 1, -1, -1):
        space, sequence = total & 1 << bit, []
        while space:
            i, a, b = parts.pop()
            taken = min(space, b - a)
            sequence.append((i, a, a + taken))
            if a + taken < b:
                parts.append((i, a + taken, b))
            space -= taken
        if sequence:
            out.append(sequence)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY,
         shard_tokens: int = SHARD_TOKENS, with_ids: bool = True) -> DataFrame:
    """Pieces with their place: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and ids (little-endian 32-bit, null unless ``with_ids``)."""
    spark = docs.sparkSession
    pieces = stage(blocks(docs, capacity, end_id, vocabulary, with_ids), "blocks")
    counts, n_docs, n_words = statistics(pieces)
    weight, mean_words = idf(counts, n_docs), n_words / max(n_docs, 1)
    rests = pieces.filter(F.col("length") < capacity)
    # keys are computed twice, from the words alone here, rather than written with all that a rest carries
    tokens = {r[0]: int(r[1]) for r in keyed(rests.select("length", "terms", "counts"), counts, weight)
              .groupBy("key").agg(F.sum("length")).collect()}  # 2^KEY_BITS rows at most
    plan = spark.createDataFrame(shard_plan(tokens, shard_tokens), "key int, first bigint, n bigint")
    sent = spark.sparkContext.broadcast(weight)

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("row")
        ids = [np.frombuffer(x, "<u4") for x in shard.column("ids").to_pylist()]
        terms, counts_ = ([np.frombuffer(x, "<u4") for x in shard.column(c).to_pylist()] for c in ("terms", "counts"))
        index = Index(terms, counts_, shard.column("n_words").to_numpy(), sent.value, mean_words)
        windows = fill(index, np.array([len(x) for x in ids], np.int64), capacity)
        sequences = [s for w in windows for s in powers(w, capacity)]
        doc_ids, starts, doc_tokens = (shard.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        first, rows = shard.column("shard")[0].as_py() << 32, []
        for number, sequence in enumerate(sequences):
            offset = 0
            for i, a, b in sequence:
                raw = ids[i][a:b].tobytes()
                rows.append((doc_ids[i], starts[i] + a, b - a, zlib.crc32(raw), doc_tokens[i], first + number, offset, raw if with_ids else None))
                offset += b - a
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*rows))[:-1]] + [pa.array([r[-1] for r in rows], pa.binary())],
                                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    # The plan has a row for each key, 2^KEY_BITS at most; a hash of the row number deals a key's rows to its shards.
    shard = F.col("first") + F.pmod(F.xxhash64("row"), F.col("n"))
    near = (keyed(rests, counts, weight).join(F.broadcast(plan), "key").withColumn("shard", shard).drop("key", "first", "n", "length", "ids_crc32")
            .groupBy("shard").applyInArrow(run, PACKED))
    full = pieces.filter(F.col("length") >= capacity).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), "ids")
    return near.unionByName(full)


@register("op12_retrieval_packing")
def op12_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 1024 tokens, filled with lexical neighbours."""
    return pack(read(spark, sf_dir, "documents"), with_ids=False).drop("ids")
