"""Line dedup by an exact set-similarity join, with DataFrame operations only.

A line is the set of its words (runs outside ``[\\x20\\x09-\\x0D]``).  A line goes
when an earlier line, in the order of doc_id, hash of the text and line number, has a Jaccard
similarity of ``num / den`` or more with it; the first of each kind stays.

* Rarity: every word counts in one of 2**RARITY_BITS counters over all
  documents; a counter's logarithmic level orders the words, rare ones first.
* Equal sets are one; its first occurrence stands for it.
* Prefix filter: similar sets share one of their first
  n - ceil(num * n / den) + 1 words in that order, so these are the join keys.
  Length and position of the shared word, and the parity of the words at 128
  hash bits, rule out most pairs in the join itself.
* Verification: the word sets of the pairs left are built again and counted.

Sets are first compared with the first and the previous line among those that
share their least or greatest word hash, as similar sets mostly do; only sets not
yet found to be later matches look for matches in the whole lists, and there the
likeliest is verified before the rest, so a large group of similar lines does
not emit all its pairs.

Defined cases: lines without words stay; null text has no lines and stays null;
rows that repeat a doc_id and text are one place and lose the same lines; different
texts of one doc_id, or of null, are places of their own, in the order of their hashes;
a null doc_id orders first; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.registry import register
from cohortlens.llm.tables import discard, read, stage

NUM, DEN = 8, 10
RARITY_BITS = 17
#: Levels of rarity for each doubling of a count.
LEVELS = 4
#: Ids up to this number are broadcast to pick their documents; beyond it they join by shuffle.
BROADCAST_IDS = 500_000
#: Numbers of 64 bits in the bitmap that verification compares first (a power of two).
BITMAP_LONGS = 8
#: What tells a line from all others, in the order of lines: document, hash of its text, line number.
PLACE = ["doc", "row", "no"]


def _spaced(text: Column) -> Column:
    """``text`` with other white space than line ends as plain spaces."""
    other = functools.reduce(operator.or_, [text.contains(c) for c in "\t\x0b\f\r"])
    return F.when(other, F.translate(text, "\t\x0b\f\r", "    ")).otherwise(text)


def _words(line: Column) -> Column:
    return F.split(line, " ")


def _text_words(text: Column) -> Column:
    """Words of all lines; line ends go by ``replace``, as ``translate`` looks up every character."""
    return _words(F.replace(_spaced(text), F.lit("\n"), F.lit(" ")))


def _lines(docs: DataFrame) -> DataFrame:
    """doc (null: least), row (hash of the text: tells rows of one doc_id apart), no, line (null: no text).

    The outer form keeps Spark from testing the split for rows first, which
    would split every text twice.
    """
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-2 ** 63)).alias("doc"), F.xxhash64(text).alias("row"),
                       _spaced(text).alias("text")).select("doc", "row", F.posexplode_outer(F.split("text", "\n")).alias("no", "line"))


def rarity_levels(docs: DataFrame) -> list[int]:
    """The level of each counter (2**RARITY_BITS numbers, whatever the input)."""
    counts = (docs.select(F.explode_outer(_text_words(F.col("text").cast("string"))).alias("w"))
              .groupBy(F.shiftrightunsigned(F.xxhash64("w"), 64 - RARITY_BITS).cast("int").alias("counter")).count().collect())
    levels = [0] * (1 << RARITY_BITS)
    for counter, n in counts:
        levels[counter] = min(127, int(LEVELS * math.log2(n)))
    return levels


def _hashes(line: Column) -> Column:
    """Hashes of the distinct words."""
    return F.array_distinct(F.array_remove(F.transform(_words(line), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))


def _ranked(hashes: Column, levels: list[int]) -> Column:
    """The words as sorted numbers: rarity level, then 56 bits of the hash."""
    table = F.split(F.lit(",".join(map(str, levels))), ",").cast("array<bigint>")  # folded to one constant
    return F.sort_array(F.transform(hashes, lambda h: F.shiftleft(F.get(table, F.shiftrightunsigned(h, 64 - RARITY_BITS)), 56)
                                    .bitwiseOR(F.shiftrightunsigned(h, 8))))


def _need(n: Column, m: Column) -> Column:
    """Words that sets of n and m must share."""
    return F.ceil((n + m) * NUM / F.lit(float(NUM + DEN)))


def line_sets(docs: DataFrame, levels: list[int]) -> DataFrame:
    """One row per different set: its first occurrence (doc, row, no), n, sig and sig2 (parity of
    the words at each of 128 bits), prefix, and its least and greatest hash."""
    hashed = _lines(docs).select("doc", "no", "row", F.coalesce(_hashes(F.col("line")), F.array().cast("array<bigint>")).alias("hashes"))
    keyed = hashed.select("doc", "no", "row", F.size("hashes").alias("n"), F.array(F.array_min("hashes"), F.array_max("hashes")).alias("ends"), _ranked(F.col("hashes"), levels).alias("keys"))
    one = F.lit(1).cast("bigint")

    def parity(half: int) -> Column:
        bit = lambda k: F.call_function("shiftleft", one, k.bitwiseAND(63).cast("int"))
        return F.aggregate("keys", F.lit(0).cast("bigint"), lambda a, k: F.when(k.bitwiseAND(64) == half, a.bitwiseXOR(bit(k))).otherwise(a))

    first = (F.col("n") - F.ceil(F.col("n") * NUM / F.lit(float(DEN))) + 1).cast("int")
    signed = keyed.select(F.xxhash64("keys").alias("hi"), F.xxhash64(F.lit(1), "keys").alias("lo"),
                          F.struct("doc", "row", "no", "n", parity(0).alias("sig"), parity(64).alias("sig2"), F.when(F.col("n") > 3, F.slice("keys", F.lit(1), first)).alias("prefix"), "ends").alias("x"))
    # lines without words are dropped as one group: a filter before would build all sets twice
    return signed.groupBy("hi", "lo").agg(F.min("x").alias("x")).select("x.*").filter("n > 0")


def _apart(a: str, b: str) -> Column:
    """Bits in which the parities of two sets differ: as many words, or more, are in one of them only."""
    return F.expr(f"bit_count({a}.sig ^ {b}.sig) + bit_count({a}.sig2 ^ {b}.sig2)")


def _similar(a: str, b: str) -> Column:
    """Length, position and parity filters; a position below 0 is -1 - position."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")

    def behind(x: str) -> Column:
        pos = F.col(f"{x}.pos")
        return F.col(f"{x}.n") - F.when(pos < 0, -1 - pos).otherwise(pos)

    need = _need(na, nb)
    return ((F.least(na, nb) * DEN >= F.greatest(na, nb) * NUM) & (F.least(behind(a), behind(b)) >= need)
            & (_apart(a, b) <= na + nb - 2 * need))


def _bitmap(hashes: str) -> Column:
    """Parity of the words at each of 64 * BITMAP_LONGS bits."""
    one = F.lit(1).cast("bigint")

    def part(i: int) -> Column:
        bit = lambda h: F.call_function("shiftleft", one, h.bitwiseAND(63).cast("int"))
        own = lambda h: F.shiftright(h, 6).bitwiseAND(BITMAP_LONGS - 1) == i
        return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, h: F.when(own(h), a.bitwiseXOR(bit(h))).otherwise(a))

    return F.array(*[part(i) for i in range(BITMAP_LONGS)])


def _marked(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_IDS else df


def _word_sets(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The word hashes s of all lines of ``pairs``, their number n and bitmap bits, once for each place (at); staged."""
    sides = [pairs.select(F.col(c).alias("at")).distinct() for c in ("a", "b")]
    places = stage(sides[0].unionByName(sides[1]).distinct().select("at.*"), "line-verify")
    n = places.count()
    docs_of = _marked(places.select(F.col("doc").alias("d"), F.col("row").alias("r")).distinct(), n)
    picked = docs.select("doc_id", "text").join(docs_of, (F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-2 ** 63)) == F.col("d"))
                                                & (F.xxhash64(F.col("text").cast("string")) == F.col("r")), "left_semi")
    found = _lines(picked).join(_marked(places, n), PLACE)
    hashed = found.select(F.struct(*PLACE).alias("at"), _hashes(F.col("line")).alias("s"))
    sets = stage(hashed.select("at", "s", F.size("s").alias("n"), _bitmap("s").alias("bits")), "line-sets")
    if sets.count() > n:  # rows that repeat a doc_id and text: each place once, or pairs multiply
        all_sets, sets = sets, stage(sets.dropDuplicates(["at"]), "line-sets-once")
        discard(all_sets)
    discard(places)
    return sets


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """doc, row, no of the later line of each pair (staged, and deleted here)
    that is similar, counted exactly; staged.  ``sets``: word sets of these lines."""
    given = pairs
    # a longer parity bitmap first: only pairs that it allows carry their whole sets along
    few = sets.select("at", "n", "bits")
    apart = " + ".join(f"bit_count(x.bits[{i}] ^ y.bits[{i}])" for i in range(BITMAP_LONGS))
    close = (pairs.select("a", "b").join(few.alias("x"), F.col("a") == F.col("x.at")).join(few.alias("y"), F.col("b") == F.col("y.at"))
             .filter(F.expr(apart) <= F.col("x.n") + F.col("y.n") - 2 * _need(F.col("x.n"), F.col("y.n"))))
    pairs = stage(close.select("a", "b"), "line-close")
    shared = F.size(F.array_intersect("sa", "sb"))
    later = stage(pairs.join(sets.select(F.col("at").alias("a"), F.col("s").alias("sa")), "a")
                  .join(sets.select(F.col("at").alias("b"), F.col("s").alias("sb")), "b")
                  .filter(shared * (NUM + DEN) >= NUM * (F.size("sa") + F.size("sb"))).select("b.*").distinct(), "line-later")
    discard(pairs, given)
    return later


def later_matches(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """doc, row, no of the first occurrence of every set that is similar to an earlier one."""
    able = sets.filter("n > 3")
    ends = able.select(*PLACE, "n", "sig", "sig2", F.posexplode("ends").alias("end", "token")).withColumn("pos", F.lit(0)).withColumn("y", F.struct(*PLACE, "n", "sig", "sig2", "pos"))
    earlier = Window.partitionBy("token", "end").orderBy(*PLACE)
    place = lambda x: F.struct(*[f"{x}.{c}" for c in PLACE])
    met = (ends.withColumn("first", F.first("y").over(earlier)).withColumn("last", F.lag("y").over(earlier))
           .select("y", F.explode(F.array("first", "last")).alias("x")).filter("x IS NOT NULL").filter(place("x") < place("y")).filter(_similar("x", "y")))
    # of the lines that it met, each takes the likeliest
    apart = _apart("x", "y").alias("apart")
    likeliest = F.min_by("a", F.struct("apart", "a")).alias("a")
    best = met.select(place("x").alias("a"), place("y").alias("b"), apart).groupBy("b").agg(likeliest)
    near = stage(best.select("a", "b"), "line-near")
    words = _word_sets(near, docs)
    done = _verified(near, words)
    discard(words)
    flagged = able.join(_marked(done.withColumn("done", F.lit(True)), done.count()), PLACE, "left")
    entries = flagged.select(*PLACE, "n", "sig", "sig2", "done", F.posexplode("prefix").alias("p", "token")).select(
        "token", F.when(F.col("done"), -1 - F.col("p")).otherwise(F.col("p")).alias("pos"), *PLACE, "n", "sig", "sig2")
    x, y = entries.alias("x"), entries.alias("y")
    # only y.pos >= 0 are open; the condition spans both sides, which then share one exchange
    is_open = F.when(F.col("y.pos") >= 0, F.col("x.n")).otherwise(F.lit(0)) > 0
    pairs = (x.join(y, (F.col("x.token") == F.col("y.token")) & is_open & F.expr("x.doc < y.doc OR x.doc = y.doc AND (x.row < y.row OR x.row = y.row AND x.no < y.no)") & _similar("x", "y"))
             .select(place("x").alias("a"), place("y").alias("b"), apart).distinct())
    pairs = stage(pairs, "line-pairs")
    words = _word_sets(pairs, docs)
    more = _verified(stage(pairs.groupBy("b").agg(likeliest).select("a", "b"), "line-likeliest"), words)
    found = _marked(more.select(F.struct(*PLACE).alias("b")), more.count())
    rest = stage(pairs.join(found, "b", "left_anti").select("a", "b"), "line-rest")
    discard(pairs)
    last = _verified(rest, words)
    discard(words)
    return done.unionByName(more).unionByName(last)


def kept_lines(docs: DataFrame) -> DataFrame:
    """doc, row, kept: the line numbers (from 0) that stay, of lines with words."""
    sets = stage(line_sets(docs, rarity_levels(docs)), "line-firsts")
    firsts = sets.select(*PLACE).join(later_matches(docs, sets), PLACE, "left_anti")
    return firsts.groupBy("doc", "row").agg(F.collect_list("no").alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with later matches taken out of the texts (``n_chars``, where
    there is one, of the new text), plus ``__lines`` and ``__kept``: the number of
    lines with words before and after."""
    kept = kept_lines(docs).select(F.col("doc").alias("__doc"), F.col("row").alias("__row"), "kept")
    own = docs.withColumn("__t", F.col("text").cast("string")).withColumn("__r", F.xxhash64("__t"))
    both = own.join(kept, (F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-2 ** 63)) == F.col("__doc")) & (F.col("__r") == F.col("__row")), "left")
    both = both.withColumn("__lines", F.split("__t", "\n")).withColumn("__kept_no", F.coalesce("kept", F.array().cast("array<int>")))
    both = both.withColumn("__blank", F.transform(F.split(_spaced(F.col("__t")), "\n"), lambda line: F.trim(line) == ""))
    n = F.coalesce(F.size(F.filter("__blank", lambda b: ~b)), F.lit(0)).cast("bigint")
    stay = F.filter("__lines", lambda line, i: F.get(F.col("__blank"), i) | F.array_contains(F.col("__kept_no"), i))
    out = both.withColumn("__n", n).withColumn("__text", F.when(F.size("__kept_no") == F.col("__n"), F.col("__t")).otherwise(F.array_join(stay, "\n")))
    new = {"text": F.col("__text"), "n_chars": F.length("__text").cast("bigint")}
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns],
                      F.col("__n").alias("__lines"), F.size("__kept_no").cast("bigint").alias("__kept"))


@register("op1_line_dedup", sql=r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
t AS (SELECT doc_id, no, line, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS s FROM l),
f AS (SELECT s, len(s) AS n, min((doc_id, no)) AS place FROM t WHERE len(s) > 0 GROUP BY s),
e AS (SELECT place, n, unnest(s) AS x FROM f),
d AS (SELECT x, count(*) AS df FROM e GROUP BY x),
k AS (SELECT place, n, x, row_number() OVER (PARTITION BY place ORDER BY df, x) AS pos FROM e JOIN d USING (x)),
pre AS (SELECT * FROM k WHERE pos <= n - ceil(n * 8 / 10) + 1),
c AS (SELECT DISTINCT a.place AS a, b.place AS b FROM pre a JOIN pre b ON a.x = b.x AND a.place < b.place AND least(a.n, b.n) * 10 >= greatest(a.n, b.n) * 8),
gone AS (SELECT DISTINCT c.b AS place FROM c JOIN f fa ON fa.place = c.a JOIN f fb ON fb.place = c.b
         WHERE len(list_intersect(fa.s, fb.s)) * 18 >= 8 * (fa.n + fb.n)),
kept AS (SELECT t.doc_id, t.no, t.line, len(t.s) AS n FROM t LEFT JOIN f ON f.s = t.s LEFT JOIN gone ON gone.place = f.place
         WHERE len(t.s) = 0 OR (f.place = (t.doc_id, t.no) AND gone.place IS NULL)),
lines AS (SELECT doc_id, count(*) FILTER (WHERE len(s) > 0) AS n FROM t GROUP BY doc_id),
texts AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS text, count(*) FILTER (WHERE n > 0) AS n FROM kept GROUP BY doc_id)
SELECT documents.doc_id, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(texts.text, '') END AS text, coalesce(lines.n, 0) AS n_lines, coalesce(texts.n, 0) AS n_kept
FROM documents LEFT JOIN lines USING (doc_id) LEFT JOIN texts USING (doc_id)""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that are similar (0.8) to an earlier line."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).withColumnsRenamed({"__lines": "n_lines", "__kept": "n_kept"})
