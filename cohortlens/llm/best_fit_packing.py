"""Best-fit packing of token sequences, planned on the histogram of lengths.

A document becomes its token ids plus an end id; one longer than a sequence is
cut into full pieces, the first of which may be shorter.  Best-fit decreasing
then runs over *counts of lengths* (at most ``capacity`` of them), not over
documents: bins with the same free space form a range of sequence ids, and
each step fills a range with pieces of one length.  A piece takes its slot by
joining its rank among the pieces of its length with the planned rank ranges.

Defined cases: null or empty text is the end id alone; repeated rows are
packed once each; null ``doc_id`` is kept and ranks first; an empty table gives
no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import contextlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.registry import register
from cohortlens.llm.tables import read, stage
from cohortlens.llm.words import Hasher, chunks, tidy_worker

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k"
#: Word encodings that a task keeps; beyond it the memory starts anew.
KEPT_WORDS = 400_000
TABLE_BITS = 20
#: Rows of one rank window: more rows of a length are split over more windows.
ROWS_PER_WINDOW = 200_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Space that is no single ASCII space byte, or a special token's name: encoded whole.
_UNUSUAL = re.compile("[\x1c-\x1f\x85\xa0  -     　]|<\\|endoftext\\|>")
#: Bytes that can begin one of those.
_SUSPECT = np.zeros(256, bool)
_SUSPECT[[0x1C, 0x1D, 0x1E, 0x1F, 0x3C, 0xC2, 0xE1, 0xE2, 0xE3]] = True


class CrossedWords(Exception):
    """A token of the vocabulary crosses from a word to a space."""


class WordEncoder:
    """Token ids of texts, encoding each different word once.

    The vocabulary's splitting rule lets no token cross from a non-space to a
    space, so a text's ids are the ids of its ``space* word`` pieces in turn.
    Texts with unusual spaces or special tokens are encoded whole, and so are
    all texts of a chunk in which a token does cross.
    """

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import base64

        import tiktoken

        self.name = vocabulary
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN,
                                          mergeable_ranks=ranks, special_tokens={})
        self.n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.n_bytes[i] = len(token)
        self.whole = None
        self.forget()

    def forget(self) -> None:
        """Drop the words and the arrays that work on them; the vocabulary stays."""
        self.hasher = Hasher()
        self.key = self.slot = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode_whole(self, text: str) -> np.ndarray:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(public_tokenizers.path(f"{self.name}.json"))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """Encode new words (those that begin with a space and end without one
        in one call, the rest one by one); returns their slots."""
        lead = np.array([_SPACE[w[0]] and not _SPACE[w[-1]] for w in words])
        joined, single = np.flatnonzero(lead), np.flatnonzero(~lead)
        ids = np.array(self.encoding.encode_ordinary(b"".join([words[i] for i in joined.tolist()]).decode()), np.uint32)
        at = np.cumsum(self.n_bytes[ids])
        ends = np.cumsum([len(words[i]) for i in joined.tolist()], dtype=np.int64)
        cut = np.searchsorted(at, ends) + 1
        if not np.array_equal(at[np.minimum(cut, len(at)) - 1], ends):
            raise CrossedWords
        parts = [np.array(self.encoding.encode_ordinary(words[i].decode()), np.uint32) for i in single.tolist()]
        count = np.concatenate([np.diff(cut, prepend=0), np.array([len(p) for p in parts], np.int64)])
        begin = len(self.ids) + np.cumsum(count) - count
        slots = np.empty(len(words), np.int64)
        slots[np.concatenate([joined, single])] = np.arange(len(words)) + len(self.count)
        self.begin, self.count = np.concatenate([self.begin, begin]), np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, ids, *parts])
        return slots

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text; ``texts`` is one chunk."""
        try:
            return self._encode_by_words(texts)
        except CrossedWords:
            return [self._encode_whole(t.decode()) for t in texts]

    def _encode_by_words(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        data = np.frombuffer(b"".join(texts), np.uint8)
        if _SUSPECT[data].any():
            for i, t in enumerate(texts):
                if _UNUSUAL.search(s := t.decode()):
                    out[i] = self._encode_whole(s)
        plain = [i for i, x in enumerate(out) if x is None]
        if len(plain) < len(texts):
            data = np.frombuffer(b"".join(texts[i] for i in plain), np.uint8)
        sizes = np.array([len(texts[i]) for i in plain], np.int64)
        if len(data):
            space = _SPACE[data]
            edge = np.zeros(len(data), bool)
            edge[1:] = space[1:] & ~space[:-1]
            doc_begin = np.cumsum(sizes) - sizes
            edge[doc_begin[sizes > 0]] = True
            starts = np.flatnonzero(edge)
            ends = np.append(starts[1:], len(data))
            if len(self.count) > KEPT_WORDS:
                self.forget()
            if not len(self.key):
                self.key = np.zeros(1 << TABLE_BITS, np.uint64)
                self.slot = np.full(1 << TABLE_BITS, -1, np.int32)
            hashes = self.hasher.ranges(data, starts, ends)
            place = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            slot = np.where(self.key[place] == hashes, self.slot[place], np.int64(-1))
            missing = np.flatnonzero(slot < 0)
            if len(missing):
                new, where, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
                raw, at = data.tobytes(), missing[where]
                learned = self._learn([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
                slot[missing] = learned[back]
                self.key[place[at]], self.slot[place[at]] = new, learned
            count = self.count[slot]
            total = np.cumsum(count)
            flat = self.ids[np.repeat(self.begin[slot] - total + count, count) + np.arange(total[-1])]
            tokens_before = np.concatenate([[0], total])[np.searchsorted(starts, np.append(doc_begin, len(data)))]
        else:
            flat, tokens_before = np.zeros(0, np.uint32), np.zeros(len(plain) + 1, np.int64)
        for k, i in enumerate(plain):
            out[i] = flat[tokens_before[k]:tokens_before[k + 1]]
        return out


@contextlib.contextmanager
def task_encoder(vocabulary: str) -> Iterator[WordEncoder]:
    """An encoder for one task; Spark keeps Python workers, so nothing of it stays in them."""
    with tidy_worker():
        encoder = WordEncoder(vocabulary)
        try:
            yield encoder
        finally:
            encoder.forget()
            del encoder


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID,
           vocabulary: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids)."""
    fields = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    schema = fields + (", ids array<int>" if with_ids else "")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_encoder(vocabulary) as encoder:
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
                for at, part in chunks(texts):
                    rows: list[tuple] = []
                    ids: list[np.ndarray] = []
                    for i, x in enumerate(encoder.encode(part)):
                        x = np.append(x, np.uint32(end_id)).astype("<u4")
                        cuts = [0, *range(len(x) % capacity or capacity, len(x) + 1, capacity)]
                        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                            rows.append((doc_ids[at + i], k, a, b - a, zlib.crc32(x[a:b].tobytes())))
                            ids.append(x[a:b])
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                    if with_ids:
                        ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
                        cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(tokenise, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths.

    Returns (length, first_rank, last_rank, first_sequence, offset): the pieces
    of that length with these ranks go to consecutive sequences, at the offset.
    Bins of equal free space are kept as ranges of sequence ids, so the work is
    bounded by the lengths, not by the pieces.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []
    out: list[tuple[int, int, int, int, int]] = []
    n_bins = 0

    def put(space: int, base: int, m: int) -> None:
        if space and m:
            if space not in free:
                bisect.insort(spaces, space)
                free[space] = []
            free[space].append((base, m))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect.bisect_left(spaces, length)
            if i < len(spaces):
                space = spaces[i]
                base, m = free[space].pop()
                if not free[space]:
                    del free[space], spaces[i]
            else:
                space, base, m = capacity, n_bins, -(-left // (capacity // length))
                n_bins += m
            each = space // length  # a bin that took one piece is the best fit for the next, while it fits
            used = min(m, left // each)
            if not used:
                each, used = left, 1
            for j in range(each):
                out.append((length, rank, rank + used - 1, base, capacity - space + j * length))
                rank += used
            left -= used * each
            put(space - each * length, base, used)
            put(space, base + used, m - used)
    return out


def rank_within(df: DataFrame, key: str, order: list[str], rows_per_window: int = ROWS_PER_WINDOW) -> DataFrame:
    """Adds ``rank`` (from 0) among the rows of ``key``; a frequent key is
    split by hash over several windows whose sizes are summed first."""
    n = df.count()
    parts = max(1, n // rows_per_window)
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    before = dealt.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.sum("_n").over(Window.partitionBy(key).orderBy("_part")) - F.col("_n"))
    own = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)) - 1
    return (dealt.withColumn("_own", own).join(before.drop("_n"), [key, "_part"])
            .withColumn("rank", F.col("_own") + F.col("_before")).drop("_part", "_own", "_before"))


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID,
         vocabulary: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """Pieces with their ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    cut = stage(pieces(docs, capacity, end_id, vocabulary, with_ids), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    slots = spark.createDataFrame(plan(histogram, capacity) or [(0, 0, -1, 0, 0)],
                                  "length bigint, first_rank bigint, last_rank bigint, first_sequence bigint, offset bigint")
    # The plan has a bounded number of rows: about capacity * ln(capacity).
    ranked = rank_within(cut, "length", ["doc_id", "piece", "ids_crc32"])
    inside = F.col("rank").between(F.col("first_rank"), F.col("last_rank"))
    return (ranked.join(F.broadcast(slots.withColumnRenamed("length", "_length")), (F.col("length") == F.col("_length")) & inside)
            .withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("first_rank"))
            .select(*cut.columns, "sequence_id", "offset"))


@register("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 1024 tokens in as few sequences as best fit finds."""
    return pack(read(spark, sf_dir, "documents"), with_ids=False)
