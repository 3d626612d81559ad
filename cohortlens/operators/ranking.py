"""Global ranks, prefix sums and exact order statistics without a global sort.

A window with an ORDER BY but no PARTITION BY pulls every row into one task.
Nothing here does.  Three ways, by what is asked:

* *which rows come first* (splits, samples): only the key at the wanted rank is
  searched, by counting key prefixes, and rows compare with it (``cut_keys``);
  no row moves;
* *the values at some ranks* (quantiles): radix selection over the bits of the
  doubles, all columns and ranks in one count a pass (``order_statistics_many``);
* *the rank of every row* (ROC, ACF, QQ points): rows are dealt to consecutive
  ranges of the order, sorted there, and offset by the sums of earlier ranges
  (``positions``, ``running_sums``); or, for keys that are hashes, in windows by
  their prefix (``cumulative``, ``hash_rank``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import materialize

_BKT = "_bkt"


def hash_bucket(key: Column | str, digits: int = 4) -> Column:
    """Bucket = first ``digits`` hex characters of an md5 key (uniform)."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("int")


def small_frame(df: DataFrame) -> DataFrame:
    """Evaluate a *bounded* summary now and re-create it as a local frame.

    Used for class sizes and per-group constants: the summary is computed by
    its own job and the big input then appears only once in the downstream plan
    (a plan that re-embeds its input for every use grows exponentially along a
    chain of ranks).  Callers guarantee the size bound.
    """
    table = df.toArrow()  # Arrow keeps NULLs (a pandas round trip turns them into NaN)
    if table.num_rows == 0:
        return df.sparkSession.createDataFrame([], df.schema)
    return df.sparkSession.createDataFrame(table, schema=df.schema)


# ------------------------------------------------------------------ cut keys

#: Hex digits of a key that one pass counts, and the rows whose whole keys it may count instead.
CUT_DIGITS = 3
WHOLE_KEYS = 4096


@dataclass(frozen=True)
class Cut:
    """The key at a rank.  Rows with a smaller key come first; of the ``ties``
    rows with this very key, ``within`` do.  No key: no row is wanted."""
    key: str | None
    within: int = 0
    ties: int = 0


def cut_keys(df: DataFrame, key: Column, wanted: Sequence[tuple[Column, int]]) -> list[Cut]:
    """The key at the given rank (from 1; 0 wants none) of each group of rows.

    ``wanted``: (condition, rank) of disjoint groups; ``key`` is an md5 hex
    string, never NULL.  Each pass counts the next ``CUT_DIGITS`` digits of the keys that
    begin like the wanted ones, 4096 counters a group, of which only the one at
    the rank comes to the driver; the last pass counts whole keys, when
    ``WHOLE_KEYS`` rows at most are left.  Passes grow with the logarithm of the
    rows, and no row is shuffled.
    """
    begin, rank = [""] * len(wanted), [r for _, r in wanted]
    left = [math.inf] * len(wanted)
    cuts: list[Cut | None] = [None if r > 0 else Cut(None) for r in rank]
    while (open_ := [i for i, c in enumerate(cuts) if c is None]):
        which, digits = F.lit(None).cast("int"), F.lit(None).cast("string")
        for i in open_:
            mine = F.coalesce(wanted[i][0], F.lit(False)) & key.startswith(begin[i])
            n = 32 if left[i] <= WHOLE_KEYS else CUT_DIGITS
            which = F.when(mine, F.lit(i)).otherwise(which)
            digits = F.when(mine, F.substring(key, len(begin[i]) + 1, n)).otherwise(digits)
        counts = (df.select(which.alias("i"), digits.alias("digits")).where("i is not null")
                  .groupBy("i", "digits").agg(F.count(F.lit(1)).alias("n")))
        through = F.sum("n").over(Window.partitionBy("i").orderBy("digits"))  # `size` rows a group at most
        at = reduce(lambda a, b: a | b, [(F.col("i") == i) & (F.col("through") >= rank[i]) & (F.col("through") - F.col("n") < rank[i]) for i in open_])
        found = {r["i"]: r for r in counts.withColumn("through", through).where(at).collect()}
        for i in open_:
            if i not in found:
                raise ValueError(f"fewer rows than the rank {wanted[i][1]} that is asked for")
            r = found[i]
            begin[i] += r["digits"]
            rank[i] -= r["through"] - r["n"]
            left[i] = r["n"]
            if len(begin[i]) == 32:
                cuts[i] = Cut(begin[i], rank[i], r["n"])
    return cuts  # type: ignore[return-value]


def select_first(df: DataFrame, key: Column, wanted: Sequence[tuple[Column, int]], flag: str) -> DataFrame:
    """Adds the boolean ``flag``: the row is among the first ``rank`` rows of its
    group by ``key`` (false outside the groups).  A projection, but for a cut
    that falls among rows of one and the same key: those are numbered apart."""
    key = F.coalesce(key, F.md5(F.lit("")))  # rows without a key tie
    cuts = cut_keys(df, key, wanted)
    first, tied = F.lit(False), F.lit(False)
    for (condition, _), cut in zip(wanted, cuts):
        if cut.key is not None:
            mine = F.coalesce(condition, F.lit(False))
            split = cut.within < cut.ties
            first = first | (mine & ((key < cut.key) if split else (key <= cut.key)))
            tied = tied | (mine & (key == cut.key)) if split else tied
    out = df.withColumn(flag, first)
    if all(c.within == c.ties for c in cuts):
        return out
    parts = [out.where(~F.coalesce(tied, F.lit(False)))]
    for (condition, _), cut in zip(wanted, cuts):
        if cut.within < cut.ties:
            same = df.where(F.coalesce(condition, F.lit(False)) & (key == cut.key))
            parts.append(positions(same, [], "_at").withColumn(flag, F.col("_at") < cut.within).drop("_at"))
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------- ranks and sums over ranges

def in_ranges(df: DataFrame, order: Sequence[Column | str], n: int | None = None) -> DataFrame:
    """Rows dealt to consecutive ranges of ``order`` and sorted in each.

    There are ``n`` ranges; without it as many as the session has shuffle
    partitions, less where AQE joins small ones, so ranges and the tasks that
    sort them grow with the data.  A row number ends the order: equal keys,
    however many, spread over several ranges.  Adds ``_range`` (ascending in the
    order) and ``_place`` (from 0 within the range).  The frame is checkpointed,
    as ranges are cut at sampled keys: every later job must see the same ones.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"_order{i}" for i in range(len(keys))]
    keyed = df.withColumns(dict(zip(names, keys))) if keys else df
    keyed = keyed.withColumn("_order", F.monotonically_increasing_id())
    by = [*[F.col(c).asc_nulls_first() for c in names], F.col("_order").asc()]
    dealt = keyed.repartitionByRange(n, *by) if n else keyed.repartitionByRange(*by)
    row = F.monotonically_increasing_id()  # range index in the upper bits, place in the lower 33
    dealt = dealt.sortWithinPartitions(*by).drop(*names, "_order").withColumn("_row", row)
    return materialize(dealt.withColumns({"_range": F.shiftright("_row", 33).cast("int"),
                                          "_place": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_row"))


def range_offsets(ranged: DataFrame, sums: Sequence[str] = ()) -> DataFrame:
    """Per range: rows (``_before``) and sums (``<v>_before``) of all earlier
    ranges, and the totals (``_total``, ``<v>_total``).  One row per range, a
    number that the driver sets; the prefix sums are taken there."""
    spark = ranged.sparkSession
    rows = (ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(v) for v in sums])
            .orderBy("_range").collect())
    names, run = ["_n", *sums], dict.fromkeys(["_n", *sums], 0)
    out = []
    for r in rows:
        out.append((r["_range"], *run.values()))
        for c in names:
            run[c] += r[c] or 0
    kinds = {v: "double" if dict(ranged.dtypes)[v] in ("double", "float") else "bigint" for v in sums} | {"_n": "bigint"}
    outs = {"_n": ("_before", "_total")} | {v: (f"{v}_before", f"{v}_total") for v in sums}
    schema = ", ".join(["_range int", *[f"`{outs[c][0]}` {kinds[c]}" for c in names], *[f"`{outs[c][1]}` {kinds[c]}" for c in names]])
    return spark.createDataFrame([(*o, *run.values()) for o in out], schema)


def positions(df: DataFrame, order: Sequence[Column | str], out: str = "position", total: str | None = None,
              n: int | None = None) -> DataFrame:
    """Adds the place of each row (from 0) in the whole table under ``order``
    (NULLs first), without a window: ranges, their row counts, and the place
    within the range.  ``total`` names a column for the number of rows."""
    ranged = in_ranges(df, order, n)
    offsets = range_offsets(ranged)
    return (ranged.join(F.broadcast(offsets), "_range")
            .withColumn(out, F.col("_before") + F.col("_place"))
            .withColumnsRenamed({"_total": total} if total else {})
            .drop("_range", "_place", "_before", "_total"))


def running_sums(df: DataFrame, order: str, values: Sequence[str], group: Sequence[str] = (),
                 with_next: str | None = None, n: int | None = None) -> DataFrame:
    """Inclusive running sums of ``values`` by ``order`` within ``group``.

    Rows lie in ranges of (group, order) (``in_ranges``); a window sums within
    each range, and the sums of a group's earlier ranges are added from a table
    with a row for each range a group has: ranges and groups together at most.
    Adds ``<v>_cum`` and ``<v>_tot`` (per group); ``with_next`` names a column
    for the next row's ``order`` in the group (NULL on the last one).
    """
    g = list(group)
    ranged = in_ranges(df, [*g, order], n)
    per = ranged.groupBy(*g, "_range").agg(F.min(order).alias("_first"), *[F.sum(v).alias(f"_{v}") for v in values])
    whole = Window.partitionBy(*g)
    by = whole.orderBy("_range")
    offsets = per.select(
        *[F.col(c).alias(f"_g_{c}") for c in g], F.col("_range").alias("_r"),
        *[(F.sum(f"_{v}").over(by) - F.col(f"_{v}")).alias(f"{v}_off") for v in values],
        *[F.sum(f"_{v}").over(whole).alias(f"{v}_tot") for v in values],
        F.lead("_first").over(by).alias("_then"))
    same = F.col("_range") == F.col("_r")
    for c in g:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    joined = ranged.join(offsets, same)
    here = Window.partitionBy(*g, "_range").orderBy("_place")
    run = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = joined.withColumns({f"{v}_cum": F.col(f"{v}_off") + F.sum(v).over(run) for v in values})
    if with_next:
        out = out.withColumn(with_next, F.coalesce(F.lead(order).over(here), F.col("_then")))
    return out.drop("_range", "_place", "_r", "_then", *[f"_g_{c}" for c in g], *[f"{v}_off" for v in values])


# -------------------------------------------------- ranks by a hash's prefix

def cumulative(df: DataFrame, order_cols: Sequence[str], values: Sequence[str], bucket: str = _BKT,
               partition_cols: Sequence[str] = (), suffix: str = "_cum", with_total: bool = True) -> DataFrame:
    """Inclusive running sums of ``values`` in ``order_cols`` order, two-level.

    ``df`` must carry ``bucket``, monotone non-decreasing in the order and, as a
    hash's prefix, even in size.  Adds ``<v>_cum`` for every value (and
    ``<v>_tot`` per partition when ``with_total``).  The per-bucket offset table
    (#buckets x #partition groups rows) is checkpointed, so that the plan of
    ``df`` occurs once, and joined as the planner likes.
    """
    pcols = list(partition_cols)
    per_bucket = df.groupBy(*pcols, bucket).agg(*[F.sum(v).alias(f"{v}_bsum") for v in values])
    prev = Window.partitionBy(*pcols).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offs = materialize(per_bucket.select(
        *pcols, bucket,
        *[F.coalesce(F.sum(f"{v}_bsum").over(prev), F.lit(0)).alias(f"{v}_off") for v in values],
        *([F.sum(f"{v}_bsum").over(Window.partitionBy(*pcols)).alias(f"{v}_tot") for v in values]
          if with_total else [])))
    joined = df.join(offs, [*pcols, bucket])
    run = Window.partitionBy(*pcols, bucket).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = joined.withColumns({f"{v}{suffix}": F.col(f"{v}_off") + F.sum(v).over(run) for v in values})
    return out.drop(*[f"{v}_off" for v in values])


def hash_rank(df: DataFrame, key: str, partition_cols: Sequence[str] = (), out: str = "rank",
              digits: int = 4, total: str | None = "n_total") -> DataFrame:
    """1-based rank by an md5 hex ``key`` within ``partition_cols``.

    ``partition_cols`` must be low-cardinality (a class label).  Adds
    ``total`` (group size) too.  Ties of equal keys get distinct, arbitrary
    ranks.
    """
    d = df.withColumn(_BKT, hash_bucket(key, digits)).withColumn("_one", F.lit(1))
    ranked = cumulative(d, [key], ["_one"], partition_cols=partition_cols, with_total=total is not None)
    ranked = ranked.withColumnRenamed("_one_cum", out)
    if total is not None:
        ranked = ranked.withColumnRenamed("_one_tot", total)
    return ranked.drop(_BKT, "_one")


# ---------------------------------------------------- exact order statistics

#: Bits of a double that one pass counts, and the open prefixes that share one (1.5 MB of counters each).
RADIX = 16
MOST_SLOTS = 64
_LOW = (1 << 63) - 1


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Signed 64-bit integers in the order of the doubles (both zeros alike)."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(_LOW), bits)


def from_ordered_bits(key: int) -> float:
    return float(np.array([key ^ _LOW if key < 0 else key], np.int64).view(np.float64)[0])


def order_statistics(df: DataFrame, col: str, ranks: Sequence[int]) -> dict[int, float]:
    """Exact values at 0-based ``ranks`` of one column (see ``order_statistics_many``)."""
    return order_statistics_many(df, {col: ranks})[col]


def order_statistics_many(df: DataFrame, ranks_by_col: dict[str, Sequence[int]]) -> dict[str, dict[int, float]]:
    """Exact values at 0-based ranks of several columns (NULL/NaN excluded).

    Radix selection on the order-preserving bits of the doubles.  A pass counts,
    for every open (column, leading bits), the next ``RADIX`` bits of the values
    that begin so, with the least and the greatest of them; tasks count into
    fixed arrays, a sum by (prefix, next bits) follows, and a window over at
    most 2^RADIX counts a prefix finds those that hold a wanted rank.  Only
    these come to the driver.  A rank is done when its bits hold a single
    value, after 64 / RADIX passes at the latest, whatever the data.
    """
    cols = list(ranks_by_col)
    result: dict[str, dict[int, float]] = {c: {} for c in cols}
    # open prefixes: (column, bits so far, leading bits) -> rank of its first value, wanted ranks
    open_ = {(ci, 0, 0): (0, sorted({int(r) for r in ranks_by_col[c]})) for ci, c in enumerate(cols) if len(ranks_by_col[c])}
    vals = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    while open_:
        slots = list(open_)[:MOST_SLOTS]
        found = _count_digits(vals, slots, [[r - open_[s][0] for r in open_[s][1]] for s in slots])
        for k, (ci, bits, prefix) in enumerate(slots):
            base, ranks = open_.pop(slots[k])
            for r in ranks:
                row = next((x for x in found if x["slot"] == k and x["before"] <= r - base < x["before"] + x["n"]), None)
                if row is None:
                    raise ValueError("rank outside the data")
                done = {row["before"]: row["lo"], row["before"] + row["n"] - 1: row["hi"]}  # the ends are known already
                at = row["lo"] if row["lo"] == row["hi"] else done.get(r - base)
                if at is not None:
                    result[cols[ci]][r] = from_ordered_bits(at)
                else:
                    key = ci, bits + RADIX, prefix << RADIX | row["digit"]
                    open_.setdefault(key, (base + row["before"], []))[1].append(r)
    return result


def _count_digits(vals: DataFrame, slots: Sequence[tuple[int, int, int]], ranks: Sequence[Sequence[int]]) -> list:
    """Rows (slot, digit, before, n, lo, hi) of the digits that hold a wanted rank."""
    by_col: dict[int, list[tuple[int, int, int]]] = {}
    for k, (ci, bits, prefix) in enumerate(slots):
        by_col.setdefault(ci, []).append((k, bits, prefix))
    radix, used = RADIX, sorted(by_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(slots), 1 << radix), np.int64)
        lo = np.full(n.shape, np.iinfo(np.int64).max)
        hi = np.full(n.shape, np.iinfo(np.int64).min)
        for batch in batches:
            for at, ci in enumerate(used):
                x = batch.column(at).drop_null().to_numpy(zero_copy_only=False)
                key = ordered_bits(x[~np.isnan(x)])
                lead = (key >> np.int64(64 - radix)) + (1 << radix - 1)  # the first digits, from 0
                for k, bits, prefix in by_col[ci]:
                    own, digit = key, lead
                    if bits:
                        rest = (key & np.int64((1 << 64 - radix) - 1)) >> np.int64(64 - bits)
                        own = key[(lead << np.int64(bits - radix) | rest) == prefix]
                        digit = own >> np.int64(64 - bits - radix) & np.int64((1 << radix) - 1)
                    n[k] += np.bincount(digit, minlength=1 << radix)
                    np.minimum.at(lo[k], digit, own)
                    np.maximum.at(hi[k], digit, own)
        slot, digit = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(digit), pa.array(n[slot, digit]),
                                          pa.array(lo[slot, digit]), pa.array(hi[slot, digit])], ["slot", "digit", "n", "lo", "hi"])

    counts = (vals.select(*[f"v{ci}" for ci in used]).mapInArrow(run, "slot int, digit bigint, n bigint, lo bigint, hi bigint")
              .groupBy("slot", "digit").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    before = F.sum("n").over(Window.partitionBy("slot").orderBy("digit")) - F.col("n")
    held = reduce(lambda a, b: a | b, [(F.col("slot") == k) & F.exists(F.array(*[F.lit(r).cast("bigint") for r in wanted]),
                                                                       lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
                                       for k, wanted in enumerate(ranks)])
    return counts.withColumn("before", before).where(held).collect()


def quantiles_type7_many(df: DataFrame, probs_by_col: dict[str, Sequence[float]],
                         counts: dict[str, int]) -> dict[str, list[float]]:
    """Type-7 quantiles of several columns in shared selection passes: R's
    default = Spark ``percentile`` = DuckDB ``quantile_cont``, exactly."""
    plans, need = {}, {}
    for c, probs in probs_by_col.items():
        n = counts[c]
        plan = []
        for p in probs:
            h = (n - 1) * p
            lo = int(math.floor(h))
            hi = min(lo + 1, n - 1)
            plan.append((lo, hi, h - lo))
            need.setdefault(c, set()).update([lo, hi])
        plans[c] = plan
    stats = order_statistics_many(df, {c: sorted(r) for c, r in need.items()})
    return {c: [stats[c][lo] + frac * (stats[c][hi] - stats[c][lo]) for lo, hi, frac in plan]
            for c, plan in plans.items()}


def quantiles_type7(df: DataFrame, col: str, probs: Sequence[float], n: int | None = None) -> list[float]:
    """``quantiles_type7_many`` of one column; its known values are counted unless ``n`` is given."""
    if n is None:
        n = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).count()
    return quantiles_type7_many(df, {col: probs}, {col: n})[col]
