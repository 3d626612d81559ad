"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def description_lines(df: DataFrame, label_col: str = "description", count_col: str = "n",
                      fallback_col: str | None = None) -> DataFrame:
    """``str(description) + " " + str(count)`` as one text column ``line``.

    A missing description prints the key (``fallback_col``) instead of failing.
    """
    label = F.col(label_col)
    if fallback_col:
        label = F.coalesce(label, F.col(fallback_col).cast("string"))
    return df.withColumn("line", F.concat_ws(" ", label, F.col(count_col).cast("string")))


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the ``line`` column as text files (one part per partition)."""
    df.select("line").write.mode(mode).text(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None,
                fmt: str = "parquet") -> None:
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_cohorts(df: DataFrame, path: str, year_col: str = "year") -> None:
    """A prepared table in one folder per cohort, so that reading a
    cohort (``readers.read_cohorts``) opens only its files."""
    write_table(df.repartition(F.col(year_col), F.pmod(F.xxhash64(*df.columns), F.lit(8))), path, "errorifexists", [year_col])
