"""Scenario runner inputs (G24): (train, test) row sets as 0/1 flag columns.

All flags live on one table, so a single design serves every scenario and
the model runs batch across them (see ``chronological``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import as_category, tolerant_double
from cohortlens.operators.sampling import downsample_majority, split_train_test
from cohortlens.plans.chronological import Scenario
from cohortlens.session import materialize


def _flag(cond) -> F.Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def standard_scenarios(df: DataFrame, label: str = "final", id_col: str = "id",
                       train_years: Sequence[int] = (2015, 2016), test_year: int = 2017,
                       names: Sequence[str] = ("years", "full", "balanced", "balimbal")) -> tuple[DataFrame, list[Scenario]]:
    """The reference's four training regimes.

    * years    -- earlier cohorts train, the last cohort tests;
    * full     -- exact 80/20 split (seed 46);
    * balanced -- down-sample the majority to the minority size, then split
                  (test balanced too; M3);
    * balimbal -- split first, down-sample the training rows only (M4).
    """
    # Each two-level rank reads its input twice; checkpointing between the
    # chained samplers keeps the plan a scan instead of nested copies of
    # the whole preparation (and lets a lost executor restart from here).
    d = split_train_test(materialize(df), id_col, 0.8, 46, out="_split")
    d = d.withColumns({"full_train": _flag(F.col("_split") == "train"), "full_test": _flag(F.col("_split") == "test"),
                       "years_train": _flag(F.col("year").isin(list(train_years))),
                       "years_test": _flag(F.col("year") == test_year)})
    d = materialize(downsample_majority(d, label, id_col, None, 1, flag="_down"))
    d = split_train_test(d, id_col, 0.8, 2, out="_bsplit", within="_down")
    d = d.withColumns({"balanced_train": _flag(F.col("_bsplit") == "train"),
                       "balanced_test": _flag(F.col("_bsplit") == "test")})
    d = downsample_majority(materialize(d), label, id_col, None, 1, flag="balimbal_train", within="full_train")
    d = d.withColumn("balimbal_test", F.col("full_test")).drop("_split", "_down", "_bsplit")
    scen = [Scenario(n, f"{n}_train", f"{n}_test") for n in names]
    return materialize(d), scen


def year_train_scenarios(df: DataFrame, years: Sequence[int] = (2015, 2016, 2017)) -> tuple[DataFrame, list[Scenario]]:
    """Train on one cohort, evaluate on the two others (two test sets, G7)."""
    cols = {f"y{a}": _flag(F.col("year") == a) for a in years}
    scen = []
    for a in years:
        others = [b for b in years if b != a]
        scen.append(Scenario(f"y{a}", f"y{a}", f"y{others[0]}", f"y{others[1]}"))
    return df.withColumns(cols), scen


def year_pair_scenarios(df: DataFrame, years: Sequence[int] = (2015, 2016, 2017)) -> tuple[DataFrame, list[Scenario]]:
    """Cross-year pairs: train on one cohort, test on another (6 pairs)."""
    cols, scen = {}, []
    for a in years:
        cols[f"y{a}"] = _flag(F.col("year") == a)
    for a in years:
        for b in years:
            if a != b:
                scen.append(Scenario(f"y{a}_on_{b}", f"y{a}", f"y{b}"))
    return df.withColumns(cols), scen


#: Preparation variants (G24) and the label each is judged by; their order is that of the bits of ``variants``.
VARIANTS = {"mark50": "pass_50", "mark55": "pass_55", "filledthendropped": "pass_50", "dropped": "pass_50"}


def preparation_variants(df: DataFrame, weekly: Sequence[str], numeric: Sequence[str], categorical: Sequence[str],
                         response: str, sparse: Sequence[str], marks: Sequence[float] = (50.0, 55.0)) -> DataFrame:
    """All preparation variants of ``prepare_student`` on one table.

    Weeks are zero-filled, the response stays numeric beside a label for each
    mark, and the bits of ``variants`` say which variants keep the row: those
    with zero fill (both marks; dropping the sparse columns afterwards)
    want complete cases of what is left, ``dropped`` also wants every week that
    is not sparse to have been there before the fill.  So a run of many variants
    shares its passes, each variant's rows being a 0/1 flag.
    """
    weeks = [w for w in weekly if w not in set(sparse)]
    original = {w: tolerant_double(w) for w in weekly}
    filled = {w: tolerant_double(F.coalesce(F.col(w), F.lit(0).cast(df.schema[w].dataType))) for w in weekly}
    others = [tolerant_double(c).isNotNull() & ~F.isnan(tolerant_double(c)) for c in [*numeric, response]]
    others += [F.col(c).isNotNull() for c in df.columns if c not in {*weekly, *numeric, response}]
    whole = F.lit(True)
    for c in others:
        whole = whole & c

    def known(columns, names):
        out = whole
        for w in names:
            out = out & columns[w].isNotNull() & ~F.isnan(columns[w])
        return out

    keeps = {"mark50": known(filled, weekly), "mark55": known(filled, weekly), "filledthendropped": known(filled, weeks), "dropped": known(original, weeks)}
    bits = F.lit(0)
    for i, name in enumerate(VARIANTS):
        bits = bits + F.when(keeps[name], F.lit(1 << i)).otherwise(F.lit(0))
    final = tolerant_double(response)
    labels = {f"pass_{mark:g}": (final >= F.lit(float(mark))).cast("int") for mark in marks}
    out = df.withColumn("variants", bits).where("variants > 0").withColumns(labels)
    # a sparse week that is no number keeps a row out of the variants that use the week, so its value does not matter
    weeks_of = {w: F.coalesce(filled[w], F.lit(0.0)) for w in weekly}
    return out.withColumns({**weeks_of, **{c: tolerant_double(c) for c in [*numeric, response]}, **{c: as_category(c) for c in categorical}})


def variant_scenarios(df: DataFrame, years: Sequence[int] = (2015, 2016, 2017)) -> tuple[DataFrame, list[Scenario]]:
    """Cross-year pairs of every preparation variant (``variants`` bits): flags ``<variant>__y<year>``."""
    cols, scen = {}, []
    for i, name in enumerate(VARIANTS):
        inside = F.col("variants").bitwiseAND(F.lit(1 << i)) > 0
        for a in years:
            cols[f"{name}__y{a}"] = _flag(inside & (F.col("year") == a))
            scen += [Scenario(f"{name}__y{a}_on_{b}", f"{name}__y{a}", f"{name}__y{b}", variant=name) for b in years if b != a]
    return df.withColumns(cols), scen
