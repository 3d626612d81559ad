"""Activity-log profiling: frequencies, top-k, dimension lookup, drill-down.

Plans: every frequency is a partial (map-side) + final hash aggregate, so a
key holding a third of all rows costs one counter per task, not a hot task.
Top-k is ``TakeOrderedAndProject``; the description lookup joins the bounded
top-k side, never the raw log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.ranking import positions, small_frame


def event_frequency(events: DataFrame, key: str = "event_id") -> DataFrame:
    """A1: count per value of ``key`` over the whole log -> (key, n)."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def entity_events(events: DataFrame, entity_value, entity: str = "user_id") -> DataFrame:
    """One entity's rows (``groupby(user).get_group(id)``) as a filter.

    A plain predicate, so it is pushed into the parquet scan.
    """
    return events.where(F.col(entity) == F.lit(entity_value))


def entity_frequency(events: DataFrame, entity_value, key: str = "event_id",
                     entity: str = "user_id") -> DataFrame:
    """A2: frequency by ``key`` for one entity."""
    return event_frequency(entity_events(events, entity_value, entity), key)


def group_summary(events: DataFrame, entity: str = "user_id", row_id: str = "event_id") -> DataFrame:
    """A3 in aggregate form: size and row-id range of each group -> (entity, n,
    first_row, last_row); ``group_listing`` has the row ids themselves."""
    return events.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(row_id).alias("first_row"),
        F.max(row_id).alias("last_row"))


def group_listing(events: DataFrame, entity: str = "user_id", row_id: str = "event_id", size: int = 10_000) -> DataFrame:
    """A3: the row ids of every group, in chunks -> (entity, chunk, n, rows).

    Rows lie in (entity, row id) order and are cut after every ``size``-th one,
    and a chunk is what one entity has between two cuts: at most ``size`` ids,
    so an entity with a large share of the log is many chunks, numbered from 0,
    and never one list.  ``rows`` are in row-id order.
    """
    placed = positions(events.select(entity, row_id), [entity, row_id], "_at")
    chunks = placed.groupBy(entity, F.floor(F.col("_at") / size).alias("_cut")).agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(row_id)).alias("rows"))
    first = F.min("_cut").over(Window.partitionBy(entity))  # over chunks, not rows
    return chunks.select(entity, (F.col("_cut") - first).alias("chunk"), "n", "rows")


def top_k(freq: DataFrame, k: int = 50, key: str = "event_id", count_col: str = "n") -> DataFrame:
    """The k most frequent keys; ties broken by key (documented change)."""
    return freq.orderBy(F.desc(count_col), F.asc(key)).limit(k)


def with_description(top: DataFrame, types: DataFrame, key: str = "event_id",
                     description: str = "description") -> DataFrame:
    """Look up each key's description; unmatched keys keep a NULL.

    Only the bounded side is ever broadcast: the dimension is streamed once
    through a left-semi join against the broadcast top-k keys (<= k rows),
    and the top-k is then left-joined to that filtered remainder (at most k
    rows for a keyed dimension).  The dimension is never shuffled or
    broadcast whole, whatever its size.
    """
    dim = types.select(key, description)
    matched = dim.join(F.broadcast(top.select(key)), key, "left_semi")
    return top.join(F.broadcast(matched), key, "left")


def top_events_described(events: DataFrame, types: DataFrame, k: int = 50, key: str = "event_id",
                         description: str = "description") -> DataFrame:
    """A1 + T1 + J1: top-k event types with description and count.

    The top-k (k rows) is evaluated once and reused by both joins, instead of
    re-aggregating the log for each use.
    """
    top = small_frame(top_k(event_frequency(events, key), k, key))
    return with_description(top, types, key, description).select(key, description, "n")


def top_k_per_entity(events: DataFrame, k: int = 50, key: str = "event_id",
                     entity: str = "user_id") -> DataFrame:
    """T2 for every entity at once: rank keys by count inside each entity.

    The window runs over the (entity, key) counts, i.e. at most
    #distinct-keys rows per entity, so a hot entity does not become a hot
    sort.
    """
    counts = events.groupBy(entity, key).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(entity).orderBy(F.desc("n"), F.asc(key))
    return (counts.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))
