"""Cohort preparation: null rules, casts, labels, cohort filters.

All of these are narrow projections/filters: Catalyst fuses them into the
scan's codegen stage and pushes the filters (cohort, class, entity) into the
parquet reader.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import as_category, pass_label, tolerant_double


def zero_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL -> 0 on a column group (the weekly marks), text columns too.

    The zero takes the column's own type, so it can run before the cast: an
    absent mark becomes 0, text that is no number stays for the cast to reject.
    """
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in columns})


def to_double(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Tolerant cast to double; unparsable values become NULL."""
    return df.withColumns({c: tolerant_double(c) for c in columns})


def to_category(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Cast to category (string)."""
    return df.withColumns({c: as_category(c) for c in columns})


def complete_cases(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """``na.omit``: drop rows with any NULL (or NaN) in ``subset``/all columns."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def drop_then_complete(df: DataFrame, sparse: Sequence[str]) -> DataFrame:
    """P5: drop the sparse columns, then keep complete cases."""
    return complete_cases(df.drop(*sparse))


def binarise(df: DataFrame, response: str = "final", mark: float = 50.0, out: str | None = None) -> DataFrame:
    """Response >= mark -> 1 else 0, NULL stays NULL."""
    return df.withColumn(out or response, pass_label(response, mark))


def cohort(df: DataFrame, year, year_col: str = "year") -> DataFrame:
    """One cohort, or several (``rbind`` of cohorts is one IN filter)."""
    if isinstance(year, (list, tuple, set)):
        return df.where(F.col(year_col).isin(list(year)))
    return df.where(F.col(year_col) == F.lit(year))


def drop_predictors(df: DataFrame, *cols: str) -> DataFrame:
    """P8."""
    return df.drop(*cols)


def class_rows(df: DataFrame, label: str = "final", value=0) -> DataFrame:
    """The rows of one class."""
    return df.where(F.col(label) == F.lit(value))


def count_where(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """P10: many predicate counts in a single pass -> one row, one column each."""
    return df.agg(*[F.count_if(cond).alias(name) for name, cond in conditions.items()])


def share_where(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Share of rows satisfying each condition (NULL rows count as no)."""
    return df.agg(*[F.avg(F.coalesce(cond, F.lit(False)).cast("double")).alias(name)
                    for name, cond in conditions.items()])


def lookup(df: DataFrame, key: str, values: Sequence) -> DataFrame:
    """Row lookup by an explicit row key (R row labels are not stable)."""
    return df.where(F.col(key).isin(list(values)))


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """P17."""
    return df.withColumnsRenamed(dict(mapping))


def union_cohorts(*dfs: DataFrame) -> DataFrame:
    """Row union of same-schema frames, matched by name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def prepare_student(df: DataFrame, weekly: Sequence[str], numeric: Sequence[str],
                    categorical: Sequence[str], response: str = "final", mark: float | None = 50.0,
                    sparse: Sequence[str] = (), variant: str = "fill") -> DataFrame:
    """The reference's preparation block as one lazy projection.

    ``variant``:
      * ``"fill"`` -- zero-fill weekly, cast, binarise, complete cases (default);
      * ``"fill_then_drop"`` -- as the reference's "missing removed" run: zero
        fill first, then drop ``sparse`` columns and keep complete cases;
      * ``"drop_only"`` -- no zero fill: drop ``sparse`` and keep complete cases.
    ``mark=None`` keeps the numeric response (linear models).
    """
    out = df
    if variant in ("fill", "fill_then_drop"):
        out = zero_fill(out, weekly)
    out = to_double(out, [*numeric, *weekly, response])
    out = to_category(out, categorical)
    if sparse:
        out = out.drop(*sparse)
    if mark is not None:
        out = binarise(out, response, mark)
    return complete_cases(out)
