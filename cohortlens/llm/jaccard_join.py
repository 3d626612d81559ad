"""Size-aware heavy-light join of documents on their word n-grams.

Documents are sets of distinct shingles of ``k`` words; two link when their
Jaccard similarity reaches ``num / den``, that is when they share at least
c(n, m) = ceil(num * (n + m) / (num + den)) shingles.

* Equal sets are one from the start.
* Light sets (fewer shingles than the boundary) enumerate all their subsets of
  each size c that a partner can ask for; two light sets that link have a
  subset of c(n, m) shingles in common, which is a join key.
* Heavy sets scan inverted lists: of their shingles in the order of rarity the
  first n - ceil(num * n / den) + 1, one of which a partner must share.  Length
  and position of the shared shingle rule out most others.
* The boundary is the set size at which scanning the lists becomes cheaper than
  enumerating, by the sums of both costs over all sets of each size.

Candidates then pass an exact bound (parity bitmaps differ in no more bits than
the sets in shingles), and those left are counted exactly.  Before, each set is
compared with few others that share one of its smallest hashes, and only lists
whose members are not all connected by then are joined with themselves, and
only between parts, so that large groups do not emit all their pairs.

Defined cases: null, empty or blank text has no shingles and links with nothing
(its own component); a text of fewer than ``k`` words is one shingle; rows with
the same ``doc_id`` count as linked; a null ``doc_id`` links with nothing and has
a null component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.components import components
from cohortlens.llm.registry import register
from cohortlens.llm.tables import discard, read, stage
from cohortlens.llm.words import Hasher, chunks, mix, scan, shingles, tidy_worker

#: Counters of the rarity table: each shingle is as rare as its counter.
RARITY_BITS = 20
#: The table is summed in parts of so many counters.
SLICE_BITS = 12
#: Smallest hashes of a set, by as many hash functions, that key the first comparisons.
MINIMA = 4
BITMAP_BITS = 1024
#: Sets of at least this size are heavy whatever the cost.
MOST_LIGHT = 40
#: Ids up to this number are broadcast to pick their documents; beyond it they join by shuffle.
BROADCAST_IDS = 500_000
#: Rounds that chain the parts of large groups; the join of lists finds whatever links they leave.
CHAIN_ROUNDS = 8
#: Rows taken out of a batch, and bytes of text worked on, at once: Python workers share their executor's memory.
ROWS, BYTES = 500, 1 << 19


def _least_shared(n: int, num: int, den: int) -> int:
    """Shingles that a set of n must share with any partner."""
    return -(-num * n // den)


def _sets(batch: pa.RecordBatch, hasher: Hasher, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text that has words."""
    column = batch.column(1).cast(pa.binary())
    texts = (t or b"" for i in range(0, len(column), ROWS) for t in column.slice(i, ROWS).to_pylist())
    for at, part in chunks(texts, BYTES):
        words = scan(part, lower=True)
        h, d = shingles(words, words.hashes(hasher), k)
        order = np.argsort(d, kind="stable")
        h = h[order]
        edge = np.searchsorted(d[order], np.arange(len(part) + 1))
        for i in range(len(part)):
            if edge[i] < edge[i + 1]:
                yield at + i, np.unique(h[edge[i]:edge[i + 1]])


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def rarity(docs: DataFrame, k: int, bits: int = RARITY_BITS) -> np.ndarray:
    """How many sets hold a shingle of each counter, over all documents
    (2**bits numbers, whatever the size of the corpus)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy_worker():
            hasher, total = Hasher(), np.zeros(1 << bits, np.uint32)
            for batch in batches:
                held: list[np.ndarray] = []
                size = 0
                for _, h in _sets(batch, hasher, k):
                    held.append((h >> np.uint64(64 - bits)).astype(np.int64))
                    size += len(h)
                    if size > 1 << 19:
                        total += np.bincount(np.concatenate(held), minlength=1 << bits).astype(np.uint32)
                        held, size = [], 0
                if held:
                    total += np.bincount(np.concatenate(held), minlength=1 << bits).astype(np.uint32)
            if total.any():
                parts = total.astype("<i8").reshape(-1, 1 << SLICE_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array([x.tobytes() for x in parts], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(x, "<i8")
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    fields = "slice bigint, counts binary"
    out = np.zeros((1 << bits >> SLICE_BITS, 1 << SLICE_BITS), np.int64)
    for i, x in _narrow(docs).mapInArrow(count, fields).repartition("slice").mapInArrow(add, fields).collect():
        out[i] = np.frombuffer(x, "<i8")
    return out.reshape(-1)


def signatures(docs: DataFrame, k: int, num: int, den: int, counts: np.ndarray) -> DataFrame:
    """Per document: n (set size), a 128-bit name of its set, the rarest
    shingles, the cost of scanning their lists, the parity bitmap, and the
    whole set of those that may be light."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(np.minimum(counts, 2 ** 31 - 1).astype(np.int32))
    mean = float(counts.mean())
    bits = int(len(counts)).bit_length() - 1
    schema = "doc_id bigint, n bigint, hi bigint, lo bigint, prefix array<bigint>, cost double, bitmap array<bigint>, small array<bigint>, minima array<bigint>"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [f.split()[0] for f in schema.split(", ")]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy_worker():
            hasher, rare = Hasher(), table.value
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                seen = np.zeros(batch.num_rows, bool)
                rows = []
                for i, h in _sets(batch, hasher, k):
                    seen[i] = True
                    n = len(h)
                    held = rare[(h >> np.uint64(64 - bits)).astype(np.int64)]
                    first = np.argsort(held, kind="stable")[:n - _least_shared(n, num, den) + 1]
                    parity = np.bincount((h & np.uint64(BITMAP_BITS - 1)).astype(np.int64), minlength=BITMAP_BITS) & 1
                    signed = h.view(np.int64)
                    rows.append((doc_ids[i], n, int(np.bitwise_xor.reduce(mix(h)).view(np.int64)), int(np.sum(mix(h ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)),
                                 signed[first], float(np.maximum(1.0, held[first] - mean).sum()),
                                 np.packbits(parity.astype(np.uint8)).view(np.int64), signed if n < MOST_LIGHT else None,
                                 [int(mix(h ^ np.uint64(0x2545F4914F6CDD1D * (j + 1) % 2 ** 64)).min().view(np.int64)) for j in range(MINIMA)]))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
                rows += [(doc_ids[i], 0, 0, 0, None, 0.0, None, None, None) for i in np.flatnonzero(~seen)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return _narrow(docs).mapInArrow(sign, schema)


def boundary(costs: list[tuple[int, int, float]], num: int, den: int) -> int:
    """Size from which sets are heavy.  ``costs``: (n, sets, cost of scanning
    the lists of these sets) for the sizes below MOST_LIGHT."""
    best = total = sum(scan_cost for _, _, scan_cost in costs)
    at = 0
    for n, sets, scan_cost in sorted(costs):
        total += sets * sum(comb(n, c) for c in range(_least_shared(n, num, den), n + 1)) - scan_cost
        if total <= best:
            best, at = total, n + 1
    return at


def _entries(sets: DataFrame, limit: int, num: int, den: int) -> DataFrame:
    """(token, c, pos, id, n): subset keys of light sets (c their size, pos -1)
    and rare shingles of heavy sets, and of light ones that a heavy may meet (c 0)."""
    def subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, n, s, label in zip(*(c.to_pylist() for c in batch.columns)):
                h = mix(np.array(s, np.int64).view(np.uint64))
                whole = int(h.sum(dtype=np.uint64))
                for c in range(_least_shared(n, num, den), n + 1):
                    for drop in itertools.combinations(h.tolist(), n - c):
                        rows.append(((whole - sum(drop)) % 2 ** 64, c, i, n, label))
            if rows:
                key, c, i, n, label = zip(*rows)
                token = mix(np.array(key, np.uint64) + np.array(c, np.uint64) * np.uint64(0xD1342543DE82EF95)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(c, pa.int32()), pa.array([-1] * len(c), pa.int32()), pa.array(i, pa.int64()), pa.array(n, pa.int64()), pa.array(label, pa.int64())],
                                                 ["token", "c", "pos", "id", "n", "label"])

    # a set of n has a partner of another size only if n or n + 1 can miss a shingle
    able = F.col("n") * den >= (F.col("n") + 1) * num
    able = able | F.expr(f"n - ceil(n * {num} / {den}) >= 1")
    light = sets.filter(F.col("n") < limit).filter(able).select("id", "n", "small", "label").mapInArrow(subsets, "token bigint, c int, pos int, id bigint, n bigint, label bigint")
    heavy = (sets.filter(F.col("n") >= _least_shared(limit, num, den)).filter(able)
             .select(F.posexplode("prefix").alias("pos", "token"), "id", "n", "label").select("token", F.lit(0).alias("c"), "pos", "id", "n", "label"))
    return light.unionByName(heavy)


def _may_link(a: str, b: str, limit: int, num: int, den: int) -> Column:
    """Length, position and light/heavy conditions on two entries of a list."""
    need = f"ceil({num} * ({a}.n + {b}.n) / {num + den})"
    return F.expr(f"least({a}.n, {b}.n) * {den} >= greatest({a}.n, {b}.n) * {num} AND "
                  f"CASE WHEN {a}.c > 0 THEN {a}.c = {need} "
                  f"ELSE greatest({a}.n, {b}.n) >= {limit} AND least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {need} END")


def _apart(a: str, b: str) -> str:
    """SQL for the bits in which two bitmaps differ."""
    return "(" + " + ".join(f"bit_count({a}.bitmap[{i}] ^ {b}.bitmap[{i}])" for i in range(BITMAP_BITS // 64)) + ")"


def _bits_allow(a: str, b: str, num: int, den: int) -> Column:
    """The parity bitmaps differ in no more bits than linked sets in shingles."""
    return F.expr(f"{_apart(a, b)} <= {a}.n + {b}.n - 2 * ceil({num} * ({a}.n + {b}.n) / {num + den})")


def _close(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose parity bitmaps allow a link, with the bits they differ in."""
    maps = sets.select("id", "n", "bitmap")
    both = pairs.join(maps.alias("x"), F.col("a") == F.col("x.id")).join(maps.alias("y"), F.col("b") == F.col("y.id"))
    return both.filter(_bits_allow("x", "y", num, den)).select("a", "b", F.col("x.n").alias("na"), F.expr(_apart("x", "y")).alias("apart"))


def _verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs (staged, and deleted with the sets built for them) whose sets reach the similarity, counted exactly; staged."""
    sides = [pairs.select(F.col(c).alias("doc_id")).distinct() for c in ("a", "b")]
    ids = stage(sides[0].unionByName(sides[1]).distinct(), "verify-ids")
    picked = _narrow(docs).join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy_worker():
            hasher = Hasher()
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                rows, size = [], 0
                for i, h in _sets(batch, hasher, k):
                    rows.append((doc_ids[i], h.view(np.int64)))
                    size += len(h)
                    if size > 1 << 18:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.list_(pa.int64())))], ["id", "s"])
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.list_(pa.int64())))], ["id", "s"])

    sets = stage(picked.mapInArrow(whole, "id bigint, s array<bigint>"), "verify-sets")
    shared = F.size(F.array_intersect("sa", "sb"))
    links = stage(pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
                  .join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
                  .filter(shared * (num + den) >= num * (F.size("sa") + F.size("sb"))).select("a", "b").distinct(), "verified")
    discard(sets, ids, pairs)
    return links


def _length_fits(a: str, b: str, num: int, den: int) -> Column:
    return F.expr(f"least({a}.n, {b}.n) * {den} >= greatest({a}.n, {b}.n) * {num}")


def first_links(docs: DataFrame, sets: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links of each set with the likeliest and the smallest of the few that it meets
    in the lists of its smallest hashes: they connect most of a large group."""
    met = F.struct("id", "n")
    lists = sets.select("id", "n", F.posexplode("minima").alias("j", "token")).withColumn("x", met)
    by_token = Window.partitionBy("token", "j").orderBy("n", "id")
    pairs = (lists.withColumn("first", F.first("x").over(by_token)).withColumn("last", F.lag("x").over(by_token))
             .select("x", F.explode(F.array("first", "last")).alias("y")).filter("y IS NOT NULL AND x.id <> y.id").filter(_length_fits("x", "y", num, den))
             .select(F.col("x.id").alias("b"), F.col("y.id").alias("a")).distinct())
    likeliest, smallest = F.min_by("a", F.struct("apart", "a")), F.min_by("a", F.struct("na", "a"))  # the smallest is many sets' hub
    near = _close(pairs, sets, num, den).groupBy("b").agg(F.array_distinct(F.array(likeliest, smallest)).alias("near"))
    return _verified(stage(near.select(F.explode("near").alias("a"), "b"), "join-near"), docs, k, num, den)


def _merged(label: DataFrame, found: DataFrame) -> DataFrame:
    """``label`` (id, label) once the parts that the links ``found`` join are one, under their smallest label."""
    between = (found.join(label.select(F.col("id").alias("a"), F.col("label").alias("la")), "a")
               .join(label.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    joined = components(between.distinct())
    return label.join(joined.select(F.col("u").alias("label"), "v"), "label", "left").select("id", F.coalesce("v", "label").alias("label"))


def _mixed(lists: DataFrame) -> DataFrame:
    """Entries of the lists whose members are not all of one part."""
    whole = Window.partitionBy("token", "c")
    return lists.withColumn("low", F.min("label").over(whole)).withColumn("high", F.max("label").over(whole)).filter("low < high").drop("low", "high")


def chained_links(docs: DataFrame, lists: DataFrame, sets: DataFrame, limit: int, k: int, num: int, den: int) -> DataFrame:
    """Links of each set with the likeliest of those of other parts that stand first,
    or just before it, in its lists: they connect the parts of a large group."""
    entry = F.struct("c", "pos", "id", "n", "label")
    by_size, by_label = (Window.partitionBy("token", "c").orderBy(*by) for by in (("n", "id"), ("label", "n", "id")))
    met = F.array(*[F.when(y["label"] != F.col("label"), y) for y in (F.first(entry).over(by_size), F.lag(entry).over(by_size), F.first(entry).over(by_label))])
    pairs = (lists.select(entry.alias("x"), met.alias("met")).select("x", F.explode(F.array_compact("met")).alias("y")).filter(_may_link("x", "y", limit, num, den))
             .select(F.col("x.id").alias("b"), F.col("y.id").alias("a")).distinct())
    likeliest = F.min_by("a", F.struct("apart", "a")).alias("a")
    return _verified(stage(_close(pairs, sets, num, den).groupBy("b").agg(likeliest).select("a", "b"), "join-chained"), docs, k, num, den)


def roots(docs: DataFrame, sets: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(id, root): the smallest id that each set is connected to, where smaller."""
    found = components(first_links(docs, sets, k, num, den))
    costs = [tuple(r) for r in sets.filter(F.col("n") < MOST_LIGHT).groupBy("n").agg(F.count(F.lit(1)), F.sum("cost")).collect()]
    limit = boundary(costs, num, den)
    labelled = sets.join(found.select(F.col("u").alias("id"), F.col("v").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
    lists = stage(_mixed(_entries(labelled, limit, num, den)), "join-lists")
    label = stage(labelled.select("id", "label").distinct(), "labels")
    for _ in range(CHAIN_ROUNDS):
        chained = chained_links(docs, lists, sets, limit, k, num, den)
        if chained.isEmpty():
            break
        former = lists, label
        label = stage(_merged(label, chained), "labels")
        lists = stage(_mixed(lists.drop("label").join(label, "id")), "join-lists")
        discard(*former)
    # the bitmaps join before the lists do, so that only close pairs leave that join
    mixed = lists.join(sets.select("id", "bitmap"), "id")
    x, y = mixed.alias("x"), mixed.alias("y")
    more = (x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.c") == F.col("y.c")) & F.expr("x.id < y.id AND x.label <> y.label")
                   & _may_link("x", "y", limit, num, den) & _bits_allow("x", "y", num, den))
            .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())
    more = stage(more, "join-more")
    discard(lists)
    return _merged(label, _verified(more, docs, k, num, den)).withColumnRenamed("label", "root")


def _class_sets(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of the documents, and of each different set once, under its smallest doc_id; both staged."""
    signed = stage(signatures(docs, k, num, den, rarity(docs, k)), "signatures")
    known = signed.filter("n > 0 AND doc_id IS NOT NULL")
    sets = known.groupBy("hi", "lo").agg(F.min("doc_id").alias("id"), F.min_by(F.struct("n", "prefix", "cost", "bitmap", "small", "minima"), "doc_id").alias("x"))
    return signed, stage(sets.select("hi", "lo", "id", "x.*"), "sets")


def _links_between(docs: DataFrame, sets: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b), a < b: every pair of different sets that link, by the heavy-light join alone; staged."""
    costs = [tuple(r) for r in sets.filter(F.col("n") < MOST_LIGHT).groupBy("n").agg(F.count(F.lit(1)), F.sum("cost")).collect()]
    limit = boundary(costs, num, den)
    entries = _entries(sets.withColumn("label", F.col("id")), limit, num, den).join(sets.select("id", "bitmap"), "id")
    x, y = entries.alias("x"), entries.alias("y")
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.c") == F.col("y.c")) & F.expr("x.id < y.id")
                   & _may_link("x", "y", limit, num, den) & _bits_allow("x", "y", num, den))
    return _verified(stage(pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "join-links"), docs, k, num, den)


def links(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(a, b), a < b: every link between documents of different sets, each set under its smallest doc_id."""
    return _links_between(docs, _class_sets(docs, k, num, den)[1], k, num, den)


def link_counts(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, class_id (smallest doc_id with the same set; null without a set or an id) and
    n_links, the number of other classes that the document's class links with."""
    signed, sets = _class_sets(docs, k, num, den)
    found = _links_between(docs, sets, k, num, den)
    ends = found.select(F.col("a").alias("id")).unionByName(found.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    of_class = sets.select("hi", "lo", "id").join(ends, "id", "left")
    own = signed.select("doc_id", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("hi")).alias("hi"), "lo")
    return own.join(of_class, ["hi", "lo"], "left").select("doc_id", F.col("id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def classes(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    signed, sets = _class_sets(docs, k, num, den)
    root = sets.select("hi", "lo", "id").join(roots(docs, sets, k, num, den), "id").select("hi", "lo", "root")
    return (signed.select("doc_id", "n", "hi", "lo").join(root, ["hi", "lo"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("root")).otherwise(F.col("doc_id")).alias("component_id")))


def deduplicated(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The documents without those that have a near copy of smaller doc_id: one
    of each group stays.  All columns; repeated rows of a doc_id stay once each."""
    keep = classes(docs, k, num, den).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").unionByName(docs.filter("doc_id IS NULL"))


@register("op4_jaccard_join", sql=r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN len(t) >= 3 THEN list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))
                          WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END AS g FROM w),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
shared AS (SELECT x FROM e GROUP BY x HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM (SELECT * FROM e SEMI JOIN shared USING (x)) a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS id, a AS root FROM both_ways UNION SELECT r.id, both_ways.b FROM r JOIN both_ways ON both_ways.a = r.root)
SELECT n.doc_id, n.n AS n_shingles, coalesce(min(r.root), n.doc_id) AS component_id FROM n LEFT JOIN r ON r.id = n.doc_id GROUP BY n.doc_id, n.n""")
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return classes(read(spark, sf_dir, "documents"), k=3, num=9, den=10)
