"""Reproducible exact-size splits, balanced down-sampling and folds.

Membership is decided by the rank of ``md5('<seed>:' || id)``: the same rows
are chosen on every run, every partitioning and every engine, and the sizes are
exact where ``randomSplit``/``sample`` are only approximate.  A split or a sample
needs no ranks: the key at its size is searched by counting key prefixes
(``ranking.cut_keys``), and each row compares its own key with that one, so no
row is shuffled or sorted.  Only folds rank every row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import order_key
from cohortlens.operators.ranking import hash_rank, select_first


def split_train_test(df: DataFrame, id_col: str = "id", frac: float = 0.8, seed=46,
                     out: str = "split", within: str | None = None) -> DataFrame:
    """M1: exactly floor(frac * n) rows get ``split='train'``, the rest ``'test'``.

    J2 (the complement) is ``where(split == 'test')`` -- no anti join.
    ``within``: split only the rows whose 0/1 column ``within`` is 1 (the
    others get NULL), keeping every row in the frame.  Rows of one id tie, rows
    without an id too; which of them come first is arbitrary, their number not.
    """
    inside = F.coalesce(F.col(within) == 1, F.lit(False)) if within else F.lit(True)
    n_train = math.floor(float(frac) * df.where(inside).count())
    flagged = select_first(df, order_key(id_col, seed), [(inside, n_train)], "_first")
    side = F.when(F.col("_first"), F.lit("train")).otherwise(F.lit("test"))
    return flagged.withColumn(out, F.when(inside, side) if within else side).drop("_first")


def downsample_majority(df: DataFrame, label: str = "final", id_col: str = "id", minority=0,
                        seed=1, flag: str | None = None, within: str | None = None) -> DataFrame:
    """M2 + U2: keep every minority row and M rows of any other class, M = minority size.

    ``minority=None`` takes the smallest class (the smaller label on a tie).
    The classes, a few by nature, are counted first; the union is a single
    filter on the rows' keys.  ``within`` restricts to rows whose 0/1 column
    is 1; ``flag`` names a 0/1 column to set instead of dropping rows.  Rows
    without a label are in no class.
    """
    inside = F.coalesce(F.col(within) == 1, F.lit(False)) if within else F.lit(True)
    sizes = {r[label]: r["n"] for r in df.where(inside & F.col(label).isNotNull()).groupBy(label)
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    small = min(sizes, key=lambda v: (sizes[v], v)) if minority is None and sizes else minority
    m = sizes.get(small, 0)
    wanted = [(inside & (F.col(label) == F.lit(v)), m) for v, n in sorted(sizes.items()) if v != small and n > m]
    whole = [v for v, n in sizes.items() if n <= m]
    flagged = select_first(df, order_key(id_col, seed), wanted, "_first")
    keep = inside & F.coalesce(F.col(label).isin(*whole), F.lit(False)) | F.col("_first") if whole else F.col("_first")
    if flag:
        return flagged.withColumn(flag, keep.cast("int")).drop("_first")
    return flagged.where(keep).drop("_first")


def balanced_then_split(df: DataFrame, label: str = "final", id_col: str = "id", minority=0,
                        frac: float = 0.8, sample_seed=1, split_seed=2) -> DataFrame:
    """M3: down-sample first, then split (the test set is balanced too)."""
    return split_train_test(downsample_majority(df, label, id_col, minority, sample_seed),
                            id_col, frac, split_seed)


def split_then_balance_train(df: DataFrame, label: str = "final", id_col: str = "id", minority=0,
                             frac: float = 0.8, split_seed=46, sample_seed=1) -> DataFrame:
    """M4: split first, then down-sample the training rows only."""
    train = F.col("split") == "train"
    s = split_train_test(df, id_col, frac, split_seed).withColumn("_train", train.cast("int"))
    kept = downsample_majority(s, label, id_col, minority, sample_seed, flag="_kept", within="_train")
    return kept.where(~train | (F.col("_kept") == 1)).drop("_train", "_kept")


def assign_folds(df: DataFrame, k: int = 10, id_col: str = "id", seed=1, out: str = "fold") -> DataFrame:
    """M5: balanced K folds: fold = (rank - 1) mod K, sizes differ by at most 1."""
    ranked = hash_rank(df.withColumn("_key", order_key(id_col, seed)), "_key", out="_rank", total=None)
    return ranked.withColumn(out, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_key", "_rank")
