"""Driver test tables and the one-row-per-person table built from them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

WEEK_COLUMNS = [f"w{i}" for i in range(1, 13)]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def student_wide(spark: SparkSession, sf_dir: str, cutoff: str = "2000-01-01 00:00:00",
                 scale: float = 5000.0) -> DataFrame:
    """One row per customer in the student-record layout (FIXTURES F4).

    id, year (cohort), segment/region (categories), acctbal (pre-course),
    w1..w12 (weekly marks, NULL when absent) and final (response, NULL when
    absent).  All twelve weekly averages and the final mark come out of ONE
    aggregation of ``orders`` keyed by customer (partial aggregation on the
    map side, one shuffle), which the customer join then reuses as its
    partitioning; nation/region are tiny dimension scans the planner
    broadcasts by their file-size statistics.
    """
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    before = F.col("o_orderdate") < F.lit(cutoff).cast("timestamp_ntz")
    month = F.month("o_orderdate")
    aggs = [(F.avg(F.when(before & (month == i), F.col("o_totalprice"))) / F.lit(scale)).alias(f"w{i}")
            for i in range(1, 13)]
    after_avg = F.avg(F.when(~before, F.col("o_totalprice"))) / F.lit(scale)
    # least() skips NULLs, so guard it: no later order means no final mark.
    aggs.append(F.when(after_avg.isNotNull(), F.least(F.lit(100.0), after_avg)).alias("final"))
    per_person = orders.groupBy(F.col("o_custkey").alias("id")).agg(*aggs)

    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    people = (customer
              .join(nation, customer.c_nationkey == nation.n_nationkey)
              .join(region, nation.n_regionkey == region.r_regionkey)
              .select(F.col("c_custkey").alias("id"),
                      (F.lit(2015) + F.col("c_custkey") % 3).alias("year"),
                      F.col("c_mktsegment").alias("segment"),
                      F.col("r_name").alias("region"),
                      F.col("c_acctbal").alias("acctbal")))
    return people.join(per_person, "id", "left").select(
        "id", "year", "segment", "region", "acctbal", *WEEK_COLUMNS, "final")


# The same table as SQL (FIXTURES F4) -- used as the oracle's common prefix.
STUDENT_WIDE_SQL = """
WITH wk AS (
  SELECT o_custkey AS id, month(o_orderdate) AS m, avg(o_totalprice)/5000 AS v
  FROM orders WHERE o_orderdate < CAST('2000-01-01 00:00:00' AS TIMESTAMP)
  GROUP BY o_custkey, month(o_orderdate)),
wide AS (
  SELECT id,
    max(CASE WHEN m=1 THEN v END) AS w1, max(CASE WHEN m=2 THEN v END) AS w2,
    max(CASE WHEN m=3 THEN v END) AS w3, max(CASE WHEN m=4 THEN v END) AS w4,
    max(CASE WHEN m=5 THEN v END) AS w5, max(CASE WHEN m=6 THEN v END) AS w6,
    max(CASE WHEN m=7 THEN v END) AS w7, max(CASE WHEN m=8 THEN v END) AS w8,
    max(CASE WHEN m=9 THEN v END) AS w9, max(CASE WHEN m=10 THEN v END) AS w10,
    max(CASE WHEN m=11 THEN v END) AS w11, max(CASE WHEN m=12 THEN v END) AS w12
  FROM wk GROUP BY id),
fin AS (
  SELECT o_custkey AS id, least(CAST(100 AS DOUBLE), avg(o_totalprice)/5000) AS final
  FROM orders WHERE o_orderdate >= CAST('2000-01-01 00:00:00' AS TIMESTAMP) GROUP BY o_custkey),
student_wide AS (
SELECT c.c_custkey AS id, 2015 + c.c_custkey % 3 AS year, c.c_mktsegment AS segment, r.r_name AS region,
  c.c_acctbal AS acctbal, w1,w2,w3,w4,w5,w6,w7,w8,w9,w10,w11,w12, f.final AS final
FROM customer c
JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN wide w ON w.id = c.c_custkey
LEFT JOIN fin f ON f.id = c.c_custkey)
"""
