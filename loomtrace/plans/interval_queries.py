"""Queries over event intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import intervals
from loomtrace.sources.views import TRACE_EVENTS, trace_events

W = "WITH " + TRACE_EVENTS


def interval_measure(spark, sf_dir):
    return intervals.measure(trace_events(spark, sf_dir), ["session_id", "kind"])


def session_stats(spark, sf_dir):
    return intervals.session_stats(trace_events(spark, sf_dir))


def parallel_groups(spark, sf_dir):
    return intervals.overlap_groups(trace_events(spark, sf_dir), ["session_id", "kind"], ["session_id"])


def concurrency_sweep(spark, sf_dir):
    return intervals.concurrency(trace_events(spark, sf_dir), ["session_id", "kind"])


def unified_kind_counts(spark, sf_dir):
    return trace_events(spark, sf_dir).groupBy("kind", "source").agg(F.count("*").alias("n"), F.count("end_us").alias("n_closed"))


def timeline_filter(spark, sf_dir):
    return trace_events(spark, sf_dir).where(intervals.on_timeline()).select("id", "session_id", "kind", "start_us", "end_us")


def event_page_keyset(spark, sf_dir):
    """The page after a cursor: up to 50 rows and one more that says whether there is a next page."""
    rows = trace_events(spark, sf_dir).where("id > 100").orderBy("id").limit(51)
    return rows.select("id", "session_id", "kind")


def top_n_recent(spark, sf_dir):
    """The newest 20 events by (start descending, id)."""
    return trace_events(spark, sf_dir).orderBy(F.desc("start_us"), "id").limit(20).select("id", "start_us")


def json_path_filter(spark, sf_dir):
    return trace_events(spark, sf_dir).where(F.get_json_object("attributes", "$.k").cast("int") > 50).select("id", F.get_json_object("attributes", "$.k").cast("int").alias("k"))


def typed_metadata_filter(spark, sf_dir):
    """Events whose attribute k is the integer 7: type and value must both match."""
    k = F.try_variant_get(F.try_parse_json("attributes"), "$.k", "variant")
    return trace_events(spark, sf_dir).where((F.schema_of_variant(k) == "BIGINT") & (F.to_json(k) == "7")).select("id", "kind")


def tag_division(spark, sf_dir):
    """Sessions that have all of three kinds."""
    has = trace_events(spark, sf_dir).groupBy("session_id").agg(F.collect_set("kind").alias("kinds"))
    return has.where(F.size(F.array_except(F.array(*map(F.lit, ("click", "purchase", "view"))), "kinds")) == 0).select("session_id")


def range_semi_activity(spark, sf_dir):
    """Users with an event in the thirty days before one of their errors: a semi join on session and day bucket, with the exact range left to check."""
    day = 86_400_000_000
    e = trace_events(spark, sf_dir)
    probes = e.where("kind = 'error'").select("session_id", F.col("start_us").alias("until"))
    probes = probes.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("until") - 30 * day) / F.lit(30 * day)), F.floor(F.col("until") / F.lit(30 * day)))))
    seen = e.where("kind = 'signup'").withColumn("bucket", F.floor(F.col("start_us") / F.lit(30 * day)))
    cond = (seen.session_id == probes.session_id) & (seen.bucket == probes.bucket) & (seen.start_us >= probes.until - 30 * day) & (seen.start_us < probes.until)
    return seen.join(probes, cond, "left_semi").select("id", "session_id")


def late_completion_merge(spark, sf_dir):
    """Open events closed by a later delivery: the stored end wins where there is one."""
    stored = trace_events(spark, sf_dir)
    late = stored.where("end_us IS NULL AND id % 8 = 0").select("id", (F.col("start_us") + 60_000_000).alias("late_end"))
    merged = stored.join(late, "id", "left").withColumn("end_us", F.coalesce("end_us", "late_end"))
    return merged.select("id", "end_us", F.col("late_end").isNotNull().alias("completed"))


def daily_windows(spark, sf_dir):
    return trace_events(spark, sf_dir).groupBy(F.floor(F.col("start_us") / F.lit(86_400_000_000)).alias("day_no"), "kind").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (interval_measure, session_stats, parallel_groups, concurrency_sweep, unified_kind_counts, timeline_filter, event_page_keyset, top_n_recent, json_path_filter, typed_metadata_filter, tag_division, range_semi_activity, late_completion_merge, daily_windows)}

SQL = {
    "interval_measure": f"""{W}, runs AS (
  SELECT *, greatest(start_us, max(end_us) OVER (PARTITION BY session_id, kind ORDER BY start_us, end_us NULLS FIRST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS seen FROM trace_events)
SELECT session_id, kind, count(*) AS n, count(end_us) AS n_closed, sum(end_us - start_us)::DOUBLE / 1000.0 AS sum_ms,
       sum(CASE WHEN end_us IS NOT NULL THEN greatest(0, end_us - seen) END)::DOUBLE / 1000.0 AS active_ms FROM runs GROUP BY session_id, kind""",
    "session_stats": f"""{W} SELECT session_id, count(*) AS n_events, count(DISTINCT kind) AS n_kinds, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, min(start_us) AS first_us,
  max(coalesce(end_us, start_us)) AS last_us, (max(coalesce(end_us, start_us)) - min(start_us))::DOUBLE / 1000.0 AS elapsed_ms,
  count(*) FILTER (kind IN ('click', 'view') OR end_us IS NOT NULL) AS timeline_count FROM trace_events GROUP BY session_id""",
    "parallel_groups": f"""{W}, x AS (SELECT * FROM trace_events WHERE end_us > start_us),
f AS (SELECT *, max(end_us) OVER (PARTITION BY session_id, kind ORDER BY start_us, end_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM x),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR start_us >= p THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, kind ORDER BY start_us, end_us, id) AS island FROM f),
s AS (SELECT session_id, kind, island, count(*) AS size, min(start_us) AS group_start, max(end_us) AS group_end, arg_min(id, (start_us, end_us, id)) AS first_id FROM g GROUP BY ALL HAVING count(*) > 1)
SELECT session_id, kind, size, group_start, group_end, first_id, 'P' || row_number() OVER (PARTITION BY session_id ORDER BY group_start, first_id) AS label FROM s""",
    "concurrency_sweep": f"""{W}, x AS (SELECT * FROM trace_events WHERE end_us > start_us),
e AS (SELECT session_id, kind, start_us AS moment, 1 AS d FROM x UNION ALL SELECT session_id, kind, end_us, -1 FROM x),
n AS (SELECT session_id, kind, moment, sum(d) AS d FROM e GROUP BY ALL),
s AS (SELECT session_id, kind, moment, sum(d) OVER w AS active, lead(moment) OVER w AS until FROM n WINDOW w AS (PARTITION BY session_id, kind ORDER BY moment))
SELECT session_id, kind, max(active)::BIGINT AS peak, sum(CASE WHEN active >= 2 THEN until - moment ELSE 0 END)::DOUBLE / 1000.0 AS overlap_ms FROM s GROUP BY session_id, kind""",
    "unified_kind_counts": f"{W} SELECT kind, source, count(*) AS n, count(end_us) AS n_closed FROM trace_events GROUP BY kind, source",
    "timeline_filter": f"{W} SELECT id, session_id, kind, start_us, end_us FROM trace_events WHERE kind IN ('click', 'view') OR end_us IS NOT NULL",
    "event_page_keyset": f"{W} SELECT id, session_id, kind FROM trace_events WHERE id > 100 ORDER BY id LIMIT 51",
    "top_n_recent": f"{W} SELECT id, start_us FROM trace_events ORDER BY start_us DESC, id LIMIT 20",
    "json_path_filter": "SELECT event_id AS id, json_extract_string(props, '$.k')::INT AS k FROM events WHERE json_extract_string(props, '$.k')::INT > 50",
    "typed_metadata_filter": "SELECT event_id AS id, event_type AS kind FROM events WHERE json_type(props, '$.k') IN ('BIGINT', 'UBIGINT') AND json_extract_string(props, '$.k') = '7'",
    "tag_division": f"{W} SELECT session_id FROM trace_events WHERE kind IN ('click', 'purchase', 'view') GROUP BY session_id HAVING count(DISTINCT kind) = 3",
    "range_semi_activity": f"{W} SELECT id, session_id FROM trace_events s WHERE kind = 'signup' AND EXISTS (SELECT 1 FROM trace_events e WHERE e.kind = 'error' AND e.session_id = s.session_id AND s.start_us >= e.start_us - 2592000000000 AND s.start_us < e.start_us)",
    "late_completion_merge": f"{W} SELECT id, coalesce(end_us, CASE WHEN id % 8 = 0 THEN start_us + 60000000 END) AS end_us, end_us IS NULL AND id % 8 = 0 AS completed FROM trace_events",
    "daily_windows": f"{W} SELECT floor(start_us / 86400000000)::BIGINT AS day_no, kind, count(*) AS n FROM trace_events GROUP BY ALL",
}
