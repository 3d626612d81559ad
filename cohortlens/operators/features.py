"""Feature construction: scaling, treatment dummies, interactions, arrival sets.

Level sets and scaling moments are small aggregates (bounded by the number
of levels / columns) read back once; the encoding itself is a projection of
literal ``when`` expressions, so it stays in codegen and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import safe_ratio, snake_case


def standardise(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """M6: ``(x - mean) / sd`` per column with one aggregate for all moments.

    Default fits on ``df`` itself (the reference scales all rows before the
    split); pass ``fit_on=train`` to avoid leaking the test rows.  A constant
    column has no scale: it becomes NULL.
    """
    src = fit_on if fit_on is not None else df
    cols = list(columns)
    st = src.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return df.withColumns({c: safe_ratio(F.col(c) - F.lit(st[f"m{i}"]), F.lit(st[f"s{i}"])) for i, c in enumerate(cols)})


@dataclass
class Encoding:
    """Treatment-contrast encoding of a set of factors.

    ``levels[f]`` is the ordered level list (first = base, dropped);
    ``columns[f]`` the dummy column names of the non-base levels.
    """
    levels: dict[str, list[str]] = field(default_factory=dict)
    columns: dict[str, list[str]] = field(default_factory=dict)

    def dummies(self, factor: str) -> list[str]:
        return self.columns[factor]


def factor_levels(df: DataFrame, factors: Sequence[str]) -> dict[str, list[str]]:
    """Distinct levels of every factor in one pass (sorted, R's default order)."""
    if not factors:
        return {}
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v"))
                                             for f in factors])).alias("s")).select("s.*")
    rows = stacked.where(F.col("v").isNotNull()).distinct().collect()
    out: dict[str, list[str]] = {f: [] for f in factors}
    for r in rows:
        out[r["f"]].append(r["v"])
    for f in out:
        out[f].sort()
    return out


def fit_encoding(df: DataFrame, factors: Sequence[str], base: Mapping[str, str] | None = None) -> Encoding:
    """M7 (+P15): levels from the full table; base level = first sorted level,
    or the one given in ``base`` (``relevel``)."""
    levels = factor_levels(df, factors)
    enc = Encoding()
    used = {c.lower() for c in df.columns}
    for f in factors:
        lv = levels[f]
        if base and f in base:
            lv = [base[f]] + [x for x in lv if x != base[f]]
        enc.levels[f] = lv
        enc.columns[f] = []
        for x in lv[1:]:  # levels that differ only in symbols or case get a number
            stem = name = f"{f}_{snake_case(x)}"
            k = 1
            while name.lower() in used:
                k += 1
                name = f"{stem}_{k}"
            used.add(name.lower())
            enc.columns[f].append(name)
    return enc


def one_hot(df: DataFrame, enc: Encoding, keep_factors: bool = False) -> DataFrame:
    """M7: add one 0/1 double column per non-base level (NULL stays NULL)."""
    cols = {}
    for f, lv in enc.levels.items():
        for name, level in zip(enc.columns[f], lv[1:]):
            cols[name] = F.when(F.col(f).isNotNull(), (F.col(f) == F.lit(level)).cast("double"))
    out = df.withColumns(cols)
    return out if keep_factors else out.drop(*enc.levels.keys())


def interactions(df: DataFrame, pairs: Sequence[tuple[Sequence[str], Sequence[str]]]) -> tuple[DataFrame, list[str]]:
    """``a*b`` = a + b + a:b as explicit products of the treatment dummies
    (or numeric columns) of each side.  Returns the frame and the new names."""
    new = {}
    for left, right in pairs:
        for a in left:
            for b in right:
                new[f"{a}__x__{b}"] = F.col(a) * F.col(b)
    return df.withColumns(new), list(new)


def arrival_sets(demographic: Sequence[str], precourse: Sequence[str],
                 fragments: Sequence[Sequence[str]]) -> list[list[str]]:
    """M8: cumulative feature sets by time point: 1 = demographic, 2 = +
    pre-course, 2 + i = + fragments 1..i."""
    sets = [list(demographic), list(demographic) + list(precourse)]
    acc = list(sets[1])
    for frag in fragments:
        acc = acc + list(frag)
        sets.append(list(acc))
    return sets


def reduced_calendar(fragments: Sequence[Sequence[str]], weeks: int = 8,
                     last: Sequence[str] | None = None) -> list[list[str]]:
    """M9: keep the first ``weeks`` fragments; optionally replace the last one."""
    out = [list(f) for f in fragments[:weeks]]
    if last is not None and out:
        out[-1] = list(last)
    return out
