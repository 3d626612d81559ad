"""Mixing sources to target weights, with DataFrame operations only.

The documents of a source, in a pseudorandom order, form one stream of words
that is cut into blocks of fixed length.  Output shards have a fixed number of
slots.  Each slot draws its source, so that a shard's source counts are one
multinomial draw; the j-th slot of a source maps, through a pseudorandom
permutation of the source's block indices (a new one for each pass over the
source), to a block, and slots and blocks join by (source, block).  Slots that
a source drew beyond its target are void, those it drew too few are added in
closing shards, so every source gives its target to the word.

Defined cases: null or empty text has size 0 and is never taken; a null source
is a source of its own, last in order; repeated rows are separate documents;
an empty table gives no rows; other columns are ignored (kept by
``mixed_documents``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.registry import register
from cohortlens.llm.tables import read, stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK = 512
SHARD_SLOTS = 4096
SEED = 20240229
#: Rounds of the swap-or-not permutation.
ROUNDS = 16
CDF_CELLS = 4096
ROWS_PER_WINDOW = 200_000
#: Up to so many sources their table is broadcast; beyond it joins shuffle.
BROADCAST_SOURCES = 50_000

_SPACES = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, _SPACES))).cast("bigint")


def _row_hash(doc_id: Column, source: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(SEED), doc_id, source, F.length(text), text)


def _ordinal() -> Column:
    """Number among rows of equal hash and id: with these it names a row, repeated ones too."""
    return F.row_number().over(Window.partitionBy("__h", "doc_id").orderBy("__h"))


def placed_documents(docs: DataFrame, rows_per_window: int = ROWS_PER_WINDOW) -> DataFrame:
    """doc_id, source, size, and the place of each document in its source's
    stream of words (``begin``).  A frequent source is split by hash over many
    windows; the sums of these come before each of them."""
    given = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")]
    h = _row_hash(F.col("doc_id"), F.col("source"), F.col("text"))
    sized = stage(docs.select(*given).select("doc_id", "source", word_count(F.col("text")).alias("size"), h.alias("__h"))
                  .withColumn("__k", _ordinal()), "mix-sizes")
    parts = max(1, sized.count() // rows_per_window)
    dealt = sized.withColumn("__part", F.pmod("__h", F.lit(parts)))
    before = dealt.groupBy("source", "__part").agg(F.sum("size").alias("__n")).withColumn(
        "__before", F.sum("__n").over(Window.partitionBy("source").orderBy("__part")) - F.col("__n"))
    within = Window.partitionBy("source", "__part").orderBy("__h", "doc_id", "__k").rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn("__own", F.sum("size").over(within) - F.col("size"))
    b = before.select(F.col("source").alias("__s"), F.col("__part").alias("__p"), "__before")
    return (own.join(b, own["source"].eqNullSafe(b["__s"]) & (own["__part"] == b["__p"]))
            .select("doc_id", "source", "size", "__h", "__k", (F.col("__own") + F.col("__before")).alias("begin")))


def source_targets(placed: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, src (its rank by code point, null last), source_size, target.

    A target is its weight's share of ``share`` times all words, but at most
    ``cap`` times the source; the excess is shared again by weight.  In the
    order of cap / weight, once a source stays below its cap all later ones do,
    and the level reached there is that of all of them.
    """
    sums = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sums.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    levels = (ranked.withColumn("__w", w).withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
              .withColumn("__all", F.sum("source_size").over(everything) * F.lit(share))
              .withColumn("__level", (F.col("__all") - F.coalesce(F.sum("__cap").over(by_ratio), F.lit(0.0)))
                          / (F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(by_ratio), F.lit(0.0)))))
    levels = levels.withColumn("__pos", F.row_number().over(Window.orderBy(F.col("__cap") / F.col("__w"), "src")))
    below = F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.struct("__pos", "__level"))
    level = F.min(below).over(everything)["__level"]  # of the first source below its cap
    return levels.select("source", "src", "source_size",
                         F.least(F.col("__cap"), F.coalesce(level * F.col("__w"), F.col("__cap"))).alias("target"))


def permuted(index: Column, n: Column, *key: Column, inverse: bool = False) -> Column:
    """A pseudorandom permutation of 0..n-1, by swap-or-not: each round pairs
    x with k - x modulo n, and a hash of the pair says whether they swap.  A
    round undoes itself, so the rounds in reverse order are the inverse."""
    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.xxhash64(F.lit(SEED), *key, r) - x, n)
        bit = F.xxhash64(F.lit(SEED + 1), *key, r, F.greatest(x, other)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(x)

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, index.cast("bigint"), swap)


def _sources_with_slots(targets: DataFrame, block: int) -> DataFrame:
    """Per source with words: its blocks, whole passes, the words of the last
    pass, the slot of the short block in that pass, and the slots in all."""
    t = targets.filter("source_size > 0").select(
        "src", "source_size", F.round("target").cast("bigint").alias("take"),
        F.ceil(F.col("source_size") / F.lit(block)).cast("bigint").alias("blocks"))
    t = t.withColumn("passes", F.expr("take div source_size")).withColumn("rest", F.expr("take % source_size"))
    t = t.withColumn("last_length", F.col("source_size") - (F.col("blocks") - 1) * block)
    t = t.withColumn("short_at", permuted(F.col("blocks") - 1, F.col("blocks"), F.col("src"), F.col("passes"), inverse=True))
    last = F.when(F.col("rest") > 0, F.least(F.col("blocks"), F.expr(f"rest div {block}") + 2)).otherwise(F.lit(0))
    return t.withColumn("slots", F.col("passes") * F.col("blocks") + last)


def _small(sources: DataFrame, n_sources: int) -> DataFrame:
    return F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources


def drawn_slots(sources: DataFrame, n_slots: int, n_sources: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(src, j, shard): the j-th slot of a source and the shard it stands in."""
    spark = sources.sparkSession
    shards = max(1, -(-n_slots // shard_slots))
    in_order = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    cdf = (sources.select("src", "slots").withColumn("hi", F.sum("slots").over(in_order) / F.lit(float(max(1, n_slots))))
           .withColumn("lo", F.lag("hi", 1, 0.0).over(Window.orderBy("src")))
           .withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CDF_CELLS), F.floor(F.col("hi") * CDF_CELLS)))))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(SEED + 2), "id"), 11) / F.lit(float(2 ** 53))
    slots = spark.range(shards * min(shard_slots, max(1, n_slots))).select("id", u.alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") * CDF_CELLS)).withColumn("shard", F.expr(f"id div {shard_slots}"))
    drawn = (slots.join(_small(cdf, n_sources), "cell").filter("u >= lo AND u < hi").select("shard", "id", "src"))
    counts = drawn.groupBy("src", "shard").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("src").orderBy("shard")) - F.col("n"))
    own = F.row_number().over(Window.partitionBy("src", "shard").orderBy("id")) - 1
    numbered = drawn.withColumn("own", own).join(counts, ["src", "shard"]).select("src", (F.col("own") + F.col("before")).alias("j"), "shard")
    kept = numbered.join(_small(sources.select("src", "slots"), n_sources), "src").filter("j < slots").select("src", "j", "shard")
    had = counts.groupBy("src").agg(F.sum("n").alias("had"))
    closing = (sources.select("src", "slots").join(had, "src", "left").withColumn("had", F.coalesce("had", F.lit(0)))
               .filter("had < slots").select("src", F.explode(F.sequence(F.col("had"), F.col("slots") - 1)).alias("j"))
               .withColumn("shard", F.lit(shards) + F.expr(f"j div {shard_slots}")))
    return kept.unionByName(closing)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP,
        block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with size and place, targets by source, taken spans).

    A span is a run of words of one document in one slot: src, begin (names the
    document in its source), pass, shard, j, start and length in words.
    """
    placed = stage(placed_documents(docs), "mix-placed")
    targets = stage(source_targets(placed, weights, share, cap), "mix-targets")
    sources = _sources_with_slots(targets, block)
    n_sources, n_slots = targets.count(), sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    s = _small(sources, n_sources)
    slots = (drawn_slots(sources, n_slots, n_sources, shard_slots).join(s, "src")
             .withColumn("pass", F.expr("j div blocks")).withColumn("at", F.expr("j % blocks"))
             .withColumn("block", permuted(F.col("at"), F.col("blocks"), F.col("src"), F.col("pass"))))
    length = F.when(F.col("block") == F.col("blocks") - 1, F.col("last_length")).otherwise(F.lit(block))
    before = F.col("at") * block - F.when(F.col("short_at") < F.col("at"), block - F.col("last_length")).otherwise(F.lit(0))
    taken = F.when(F.col("pass") < F.col("passes"), length).otherwise(F.greatest(F.lit(0), F.least(length, F.col("rest") - before)))
    slots = slots.withColumn("taken", taken).filter("taken > 0").select("src", "block", "pass", "shard", "j", "taken")
    own = _small(targets.select(F.col("source").alias("__s"), "src"), n_sources)
    parts = (placed.filter("size > 0").join(own, F.col("source").eqNullSafe(F.col("__s")))
             .select("src", "begin", "size", F.explode(F.expr(f"sequence(begin div {block}, (begin + size - 1) div {block})")).alias("block"))
             .withColumn("from", F.greatest(F.col("begin") - F.col("block") * block, F.lit(0)))
             .withColumn("to", F.least(F.col("begin") + F.col("size") - F.col("block") * block, F.lit(block))))
    spans = (slots.join(parts, ["src", "block"]).filter(F.col("from") < F.col("taken"))
             .select("src", "begin", "pass", "shard", "j", (F.col("block") * block + F.col("from") - F.col("begin")).alias("start"),
                     (F.least("to", "taken") - F.col("from")).alias("length")))
    return placed, targets, spans


def taken_words(placed: DataFrame, targets: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per document."""
    n = targets.count()
    own = _small(targets.select(F.col("source").alias("__s"), "src", "source_size", "target"), n)
    sums = spans.groupBy("src", "begin").agg(F.sum("length").alias("taken"))
    known = placed.join(own, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    # documents without words share their place with the next one
    place = F.when(F.col("size") > 0, F.col("begin")).otherwise(-1 - F.col("begin"))
    return (known.withColumn("begin", place).join(sums, ["src", "begin"], "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents: one row for each document and pass that takes words
    of it, its text the taken words with the white space between them; all
    columns of ``docs``, ``n_chars`` (where there is one) of the new text."""
    placed, targets, spans = mix(docs, **settings)
    own = _small(targets.select(F.col("source").alias("__s"), "src"), targets.count())
    passes = spans.groupBy("src", "begin", "pass").agg(
        F.sum("length").alias("__taken"), F.sort_array(F.collect_list(F.struct("start", "length"))).alias("__spans"))
    chosen = (placed.filter("size > 0").join(own, F.col("source").eqNullSafe(F.col("__s")))
              .join(passes, ["src", "begin"]).select(F.col("__h").alias("__mh"), F.col("doc_id").alias("__md"), F.col("__k").alias("__mk"), "size", "__taken", "__spans"))
    # columns travel under numbers, whatever their names, and the text once
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    whole = F.col(at["text"]).cast("string")
    named = docs.toDF(*at.values()).withColumn("doc_id", F.col(at["doc_id"]).cast("bigint"))
    named = named.withColumn("__h", _row_hash(F.col("doc_id"), F.col(at["source"]).cast("string"), whole)).withColumn("__k", _ordinal())
    hit = named.join(chosen, (F.col("__h") == F.col("__mh")) & F.col("doc_id").eqNullSafe(F.col("__md")) & (F.col("__k") == F.col("__mk")))
    # each word with the white space behind it; leading white space goes with the first
    words = F.split(whole, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(whole.rlike(r"^[\x20\x09-\x0D]"), F.lit(1)).otherwise(F.lit(0))
    cut = F.rtrim(F.array_join(F.flatten(F.transform("__spans", lambda s: F.slice("__words", (s["start"] + 1 + F.col("__lead")).cast("int"), s["length"].cast("int")))), ""))
    text = F.when(F.col("__taken") == F.col("size"), whole).otherwise(cut)
    out = hit.withColumn("__words", words).withColumn("__lead", lead).withColumn("__text", text)
    new = {"text": F.col("__text"), "n_chars": F.length("__text").cast("bigint")}
    return out.select(*[new.get(c, F.col(at[c])).alias(c) for c in docs.columns])


@register("op5_source_mixing")
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents to the target weights takes of each."""
    return taken_words(*mix(read(spark, sf_dir, "documents")))
