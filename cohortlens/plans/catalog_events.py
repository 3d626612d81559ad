"""Registered queries: activity-log profiling over ``events`` (Entry A).

Mapping to the reference log: ``event_type`` is the event-type key,
``user_id`` the person.  The event-type dimension (J1) is derived from the
log itself: one row per type with a description string.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import events as ev
from cohortlens.functions.columns import first_match
from cohortlens.operators.ranking import small_frame
from cohortlens.plans.registry import register
from cohortlens.sources.sinks import description_lines
from cohortlens.sources.tables import load

KEY = "event_type"


def event_types(events):
    """The dimension: one row per event type, keyed like the log."""
    return (events.select(KEY).distinct()
            .withColumn("description", F.concat(F.lit("event type "), F.col(KEY))))


def _top_user(events):
    """The most active user (ties -> smallest id), as a one-row frame."""
    return ev.top_k(ev.event_frequency(events, "user_id"), 1, "user_id").select("user_id")


@register("events_top50_described", """
WITH f AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type
           ORDER BY n DESC, event_type LIMIT 50),
d AS (SELECT DISTINCT event_type, concat('event type ', event_type) AS description FROM events)
SELECT f.event_type, d.description, f.n, concat_ws(' ', d.description, CAST(f.n AS VARCHAR)) AS line
FROM f LEFT JOIN d USING (event_type)
""")
def events_top50_described(spark, sf_dir):
    """A1 + T1 + J1 + S5: top-50 event types with description and count."""
    events = load(spark, sf_dir, "events")
    top = ev.top_events_described(events, event_types(events), 50, KEY)
    return description_lines(top, fallback_col=KEY)


@register("event_frequency", """
SELECT event_type, count(*) AS n FROM events GROUP BY event_type
""")
def event_frequency(spark, sf_dir):
    """A1: frequency of every event type over the whole log."""
    return ev.event_frequency(load(spark, sf_dir, "events"), KEY)


@register("entity_event_frequency", """
SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type
""")
def entity_event_frequency(spark, sf_dir):
    """A2 for every entity: frequency by event type per user."""
    return load(spark, sf_dir, "events").groupBy("user_id", KEY).agg(F.count(F.lit(1)).alias("n"))


@register("drilldown_top_user", """
WITH u AS (SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1),
f AS (SELECT e.event_type, count(*) AS n FROM events e JOIN u ON e.user_id = u.user_id GROUP BY e.event_type
      ORDER BY n DESC, event_type LIMIT 50)
SELECT f.event_type, concat('event type ', f.event_type) AS description, f.n FROM f
""")
def drilldown_top_user(spark, sf_dir):
    """P12 + A2 + T2 + J1: top-50 event types of the most active user.

    The entity is found by a top-1 over user frequencies; the drill-down is
    a left-semi join on that one-row result (broadcast, bounded to 1 row).
    """
    events = load(spark, sf_dir, "events")
    one = events.join(F.broadcast(small_frame(_top_user(events))), "user_id", "left_semi")
    top = small_frame(ev.top_k(ev.event_frequency(one, KEY), 50, KEY))
    return ev.with_description(top, event_types(events), KEY).select(KEY, "description", "n")


@register("top3_per_user", """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rank FROM c)
SELECT user_id, event_type, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3
""")
def top3_per_user(spark, sf_dir):
    """T2 per entity: each user's three most frequent event types."""
    return ev.top_k_per_entity(load(spark, sf_dir, "events"), 3, KEY, "user_id")


@register("user_group_summary", """
SELECT user_id, count(*) AS n, min(event_id) AS first_row, max(event_id) AS last_row
FROM events GROUP BY user_id
""")
def user_group_summary(spark, sf_dir):
    """A3: per-user group size and row-id range."""
    return ev.group_summary(load(spark, sf_dir, "events"), "user_id", "event_id")


@register("user_row_listing", """
WITH r AS (SELECT user_id, event_id, (row_number() OVER (ORDER BY user_id, event_id) - 1) // 7 AS cut FROM events),
c AS (SELECT user_id, cut, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS rows FROM r GROUP BY ALL)
SELECT user_id, CAST(cut - min(cut) OVER (PARTITION BY user_id) AS BIGINT) AS chunk, n, rows FROM c
""")
def user_row_listing(spark, sf_dir):
    """A3: every user's row ids in chunks of at most 7 (small, so that the given users have several)."""
    out = ev.group_listing(load(spark, sf_dir, "events"), "user_id", "event_id", 7)
    return out.withColumn("rows", F.concat_ws(",", F.transform("rows", lambda r: r.cast("string"))))


@register("first_matching_type", """
WITH u AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS types FROM events GROUP BY user_id)
SELECT user_id, list_filter(types, lambda x: regexp_matches(x, '^[c-p]'))[1] AS first_type FROM u
""")
def first_matching_type(spark, sf_dir):
    """2.12 ``grep(p, x)[1]``: the first of each user's event types (sorted) that matches a pattern."""
    types = load(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("types"))
    return types.select("user_id", first_match("types", "^[c-p]").alias("first_type"))


@register("event_frequency_stream", """
SELECT event_type, count(*) AS n FROM events GROUP BY event_type
""")
def event_frequency_stream(spark, sf_dir):
    """A1 maintained by Structured Streaming: a file-stream source over the
    events file, a complete-mode streaming aggregation (state = one counter
    per type) run to completion with an availableNow trigger."""
    from cohortlens.streaming import frequency_stream, read_log_stream, run_available
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").schema
    # a file source watches a folder or glob; the glob names the one log file
    stream = read_log_stream(spark, f"{sf_dir}/events.parquet*", schema)
    return run_available(frequency_stream(stream, [KEY]), "event_frequency")


@register("activity_log_scan", """
WITH f AS (SELECT CAST(weekofyear(ts) AS INTEGER) AS period, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT period, event_type, concat('event type ', event_type) AS description, n FROM f
""")
def activity_log_scan(spark, sf_dir):
    """S1 + S2 + S4 + A1 + J1: the events table laid out as the reference's
    logs -- one headerless CSV folder per period with the fixed seven columns,
    plus a header CSV of event types keyed by its first column -- written to
    the shared checkpoint folder, scanned back with the explicit schema,
    unioned with a period column, profiled per period and described."""
    import posixpath
    import uuid

    from cohortlens.session import ensure_checkpoint_dir
    from cohortlens.sources import readers as rd

    events = load(spark, sf_dir, "events")
    root = posixpath.join(ensure_checkpoint_dir(spark), "logs", uuid.uuid4().hex[:8])  # a URI on a cluster
    log = events.select(F.weekofyear("ts").alias("period"),
                        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_date"),
                        F.col(KEY).alias("event_id"), F.col("event_id").cast("string").alias("ref"),
                        F.col("user_id").cast("string").alias("user_id"), F.lit("site").alias("site_id"),
                        F.lit("student").alias("role_id"), F.lit("1").alias("is_student"))
    log.write.partitionBy("period").option("header", "false").csv(posixpath.join(root, "log"))
    event_types(events).select(F.col(KEY).alias("EVENT_ID"), F.col("description").alias("DESCRIPTION")) \
        .write.option("header", "true").csv(posixpath.join(root, "types"))
    periods = sorted(r[0] for r in log.select("period").distinct().collect())  # a handful of weeks
    scanned = rd.read_by_year(spark, {p: posixpath.join(root, "log", f"period={p}") for p in periods},
                              year_col="period")
    types = rd.read_dimension(spark, posixpath.join(root, "types"), key="event_id")
    freq = scanned.groupBy("period", "event_id").agg(F.count(F.lit(1)).alias("n"))
    out = freq.join(types.select("event_id", "description"), "event_id", "left")
    return out.select(F.col("period").cast("int").alias("period"), F.col("event_id").alias(KEY), "description", "n")
