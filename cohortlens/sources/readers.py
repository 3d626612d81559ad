"""File scans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.columns import snake_case

# The activity-log column order (headerless files).
ACTIVITY_LOG_COLUMNS = ["event_date", "event_id", "ref", "user_id", "site_id", "role_id", "is_student"]

ACTIVITY_LOG_SCHEMA = T.StructType([
    T.StructField("event_date", T.TimestampType(), True),
    T.StructField("event_id", T.StringType(), True),
    T.StructField("ref", T.StringType(), True),
    T.StructField("user_id", T.StringType(), True),
    T.StructField("site_id", T.StringType(), True),
    T.StructField("role_id", T.StringType(), True),
    T.StructField("is_student", T.StringType(), True),
])


def read_activity_log(spark: SparkSession, paths: str | Sequence[str],
                      schema: T.StructType = ACTIVITY_LOG_SCHEMA, sep: str = ",") -> DataFrame:
    """Headerless delimited scan with fixed names and an explicit schema."""
    return (spark.read.schema(schema).option("header", "false").option("sep", sep)
            .option("mode", "PERMISSIVE").csv(paths))


def read_dimension(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """CSV with a header whose first column is the key.

    Names are sanitised; the first column is renamed to ``key`` if given.
    """
    df = spark.read.option("header", "true").csv(path)
    df = sanitize_columns(df)
    if key is not None and df.columns[0] != key:
        df = df.withColumnRenamed(df.columns[0], key)
    return df


def sanitize_columns(df: DataFrame) -> DataFrame:
    """S3: rename every column to snake_case; clashes get a numeric suffix."""
    seen: dict[str, int] = {}
    mapping = {}
    for c in df.columns:
        s = snake_case(c)
        if s in seen:
            seen[s] += 1
            s = f"{s}_{seen[s]}"
        else:
            seen[s] = 0
        if s != c:
            mapping[c] = s
    return df.withColumnsRenamed(mapping) if mapping else df


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """S3: wide table scan (parquet or CSV) with name sanitising."""
    reader = spark.read.options(**options)
    if fmt == "csv":
        reader = reader.option("header", options.get("header", "true"))
    return sanitize_columns(reader.format(fmt).load(path))


def read_by_year(spark: SparkSession, paths_by_year: Mapping[int, str | Sequence[str]],
                 reader=None, year_col: str = "year") -> DataFrame:
    """Union of the same source over several years, tagged with ``year``.

    One scan node per year, unioned by name, so a later ``filter(year == y)``
    prunes the other scans entirely and ``groupBy(year, ...)`` replaces the
    reference's three copy-pasted blocks with one job.
    """
    reader = reader or (lambda p: read_activity_log(spark, p))
    parts = [reader(p).withColumn(year_col, F.lit(int(y))) for y, p in sorted(paths_by_year.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_cohorts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table ``sinks.write_cohorts`` wrote; a filter on the year
    reads only the folders of those years.  Columns are those of ``schema``."""
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
