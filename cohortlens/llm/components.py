"""Connected components of a link table, by large-star and small-star steps.

Each step points the neighbours of a node to the smallest of them, first those
larger than the node, then the others, until no link changes; every component
ends as a star around its smallest node.  Links stay distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.tables import discard, stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links``: (u, v) with u > v."""
    if large:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = (links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))))
    return moved.filter("u <> v").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(u, v), u > v: each node that is not its component's smallest, and that smallest."""
    now = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    state = _state(now)
    while state[0]:
        before, now = now, stage(_star(_star(now, True), False), "links")
        discard(before)
        if (new := _state(now)) == state:
            break
        state = new
    return now
