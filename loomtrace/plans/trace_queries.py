"""Queries over spans, log records and composed timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import traces as T
from loomtrace.sources.storage import table
from loomtrace.sources.views import NUMBERED, TRACE_EVENTS, numbered_lines, trace_events


def otlp_any_values(spark, sf_dir):
    """Attributes of the events in the wire's JSON, opened again: text, integers as text, numbers, flags, lists, key-value lists."""
    e = trace_events(spark, sf_dir)
    entry = lambda key, kind, value: F.concat(F.lit('{"key":"' + key + '","value":{"' + kind + '":'), value, F.lit("}}"))
    k = F.get_json_object("attributes", "$.k")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    inner = F.concat(F.lit('{"values":['), entry("source", "stringValue", quoted(F.col("source"))), F.lit(","), entry("n", "intValue", quoted(k)), F.lit("]}"))
    parts = [entry("kind", "stringValue", quoted(F.col("kind"))), entry("k", "intValue", quoted(k)), entry("open", "boolValue", F.when(F.col("end_us").isNull(), "true").otherwise("false")), entry("half", "doubleValue", F.concat(k, F.lit(".5"))), entry("list", "arrayValue", F.concat(F.lit('{"values":['), k, F.lit("]}"))), entry("of", "kvlistValue", inner)]
    body = e.select("id", F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")).alias("attributes"))
    return T.any_values(body, "id", "attributes")


def spans(spark, sf_dir):
    """Line items as spans of their order, each the child of the line before; some name a conversation, some in their events."""
    li = numbered_lines(spark, sf_dir)
    p, s = F.col("l_partkey"), F.col("l_suppkey").cast("string")
    uuid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(s, 12, "0"))
    one = lambda cond, key, value: F.when(cond, F.create_map(F.lit(key), value)).otherwise(F.create_map().cast("map<string,string>"))
    record = F.when(p % 50 == 0, F.create_map(F.lit("session.id"), F.concat(F.lit("s"), s))).when(p % 40 == 1, F.create_map(F.lit("thread_id"), uuid)).when(p % 40 == 2, F.create_map(F.lit("thread.id"), s)).otherwise(F.create_map().cast("map<string,string>"))
    events = F.when(p % 30 == 3, F.array(F.create_map(F.lit("conversation.id"), F.concat(F.lit("c"), s)))).when(p % 30 == 4, F.array(F.create_map(F.lit("conversation.id"), F.concat(F.lit("c"), s)), F.create_map(F.lit("session.id"), F.lit("other"))))
    return li.select(
        F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("span_id"), F.when((F.col("l_linenumber") > 1) & (p % 5 != 0), F.col("l_linenumber") - 1).alias("parent_span_id"),
        one(p % 97 == 0, "session.id", F.lit("resource")).alias("resource"), one(p % 89 == 0, "gen_ai.conversation.id", F.lit("scope")).alias("scope"), record.alias("record"), events.alias("events"),
    )


SPANS = f"""{NUMBERED}, raw AS (SELECT l_orderkey AS trace_id, l_linenumber AS span_id, CASE WHEN l_linenumber > 1 AND l_partkey % 5 <> 0 THEN l_linenumber - 1 END AS parent_span_id, l_partkey AS p, l_suppkey::VARCHAR AS s FROM numbered),
spans AS (SELECT *, CASE WHEN p % 50 = 0 THEN 's' || s WHEN p % 97 = 0 THEN 'resource' WHEN p % 89 = 0 THEN 'scope' WHEN p % 40 = 1 THEN '00000000-0000-4000-8000-' || lpad(s, 12, '0') END AS own,
  CASE WHEN p % 50 = 0 THEN 'session.id' WHEN p % 97 = 0 THEN 'session.id' WHEN p % 89 = 0 THEN 'gen_ai.conversation.id' WHEN p % 40 = 1 THEN 'thread_id (UUID)' END AS own_basis, CASE WHEN p % 30 = 3 THEN ['c' || s] WHEN p % 30 = 4 THEN ['c' || s, 'other'] ELSE [] END AS nested FROM raw),
identified AS (SELECT trace_id, span_id, parent_span_id, coalesce(own, CASE WHEN len(nested) = 1 THEN nested[1] END) AS direct, coalesce(own_basis, CASE WHEN len(nested) = 1 THEN 'span event conversation identity' END) AS basis, list_sort(list_distinct(nested || CASE WHEN own IS NULL THEN [] ELSE [own] END)) AS candidates FROM spans)"""


def span_identities(spark, sf_dir):
    """Identity, what it rests on, and all candidates of each span."""
    return T.identified(spans(spark, sf_dir)).select("trace_id", "span_id", "direct", "basis", F.array_join("candidates", "|").alias("candidates"))


def span_sessions(spark, sf_dir):
    """The session of each span: its own, an ancestor's, the trace's only one, or the trace."""
    return T.attributed(T.identified(spans(spark, sf_dir)))


def bucket_sessions(spark, sf_dir):
    """Sessions that are but traces: all their spans are under the trace's id."""
    of = span_sessions(spark, sf_dir)
    return T.buckets(of.select("session_id", F.col("trace_id").cast("string").alias("trace_id"), F.lit("trace").alias("source")))


def record_classes(spark, sf_dir):
    """Kind, status and times of events as spans and logs by turns, with durations back from a log's time."""
    e = trace_events(spark, sf_dir)
    k = F.get_json_object("attributes", "$.k").cast("int")
    names = F.array(*map(F.lit, ("agent.api_request", "agent.tool_result", "agent.user_prompt", "agent.sse_event", "run_tool", "mcp.request_user_input")))
    rows = e.select(
        "id", F.when(F.col("id") % 2 == 0, "traces").otherwise("logs").alias("signal"), F.element_at(names, k % 6 + 1).alias("name"), F.when(k % 5 == 1, "chat").when(k % 5 == 2, "execute_tool").alias("operation"), F.when(k % 9 == 0, "shell").when(k % 9 == 1, "ui.request_user_input").alias("tool_name"),
        (k % 20).alias("severity"), F.when(k % 8 == 0, "False").alias("success"), (k % 3).alias("status_code"), (F.col("start_us") * 1000).alias("at_ns"), (F.col("end_us") * 1000).alias("end_at_ns"), F.when(k % 4 != 0, (k - 5) * F.lit(0.5)).alias("duration_ms"),
    )
    return T.classified(rows).select("id", "kind", "status", "start_ns", "end_ns", "timing")


def item_times(spark, sf_dir):
    """Bounds of items in nanoseconds, by epoch milliseconds or a reported duration."""
    e = trace_events(spark, sf_dir)
    k = F.get_json_object("attributes", "$.k").cast("int")
    items = e.select("id", F.when(F.col("kind") == "click", "tool").otherwise("llm").alias("kind"), F.floor(F.col("start_us") / 1000).alias("started_at_ms"), F.floor(F.col("end_us") / 1000).alias("completed_at_ms"), F.when(k % 3 == 0, k).cast("long").alias("secs"), F.when(k % 5 == 0, k * 1000).cast("long").alias("nanos"))
    return T.item_bounds(items).select("id", "start_ns", "end_ns")


def producers(spark, sf_dir):
    """Orders as sessions: the application's own, and the parents that they inherit."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "paginated").alias("mode"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey").cast("string")).alias("forked"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey").cast("string")).otherwise("x").alias("parent"), F.col("o_custkey").cast("string").alias("origin"), F.when(F.col("o_orderstatus") != "P", "subagent").otherwise("cli").alias("source"))
    return o.select("o_orderkey", T.own_producer(["1-URGENT", "P"], "o_orderpriority", "o_orderstatus").alias("producer"), T.inherited_parent("mode", "forked", "parent", "source", "origin").alias("inherited_from"))


def _composed(spark, sf_dir):
    e = trace_events(spark, sf_dir).withColumn("k", F.get_json_object("attributes", "$.k").cast("int"))
    e = e.withColumns({"turn_id": F.floor(F.col("k") / 50), "call_id": F.when(F.col("k") % 11 != 0, F.col("k")), "parent_call_id": F.when(F.col("id") % 4 == 0, F.col("k") - 1)})
    shown = lambda kinds, tool: e.where(F.col("kind").isin(*kinds)).withColumns({"text": F.concat("kind", F.lit(" "), F.col("k").cast("string")), "kind": F.when(F.col("kind") == tool, "tool").otherwise("user_wait")})
    columns = ["id", "session_id", "turn_id", "call_id", "kind", "start_us", "end_us", "text"]
    return T.composed(shown(("click", "purchase"), "click").select(columns), shown(("view", "error"), "view").select(*columns, "parent_call_id"))


def timeline_composed(spark, sf_dir):
    """Calls and items as one list: matched, child, ambiguous or unmatched."""
    return _composed(spark, sf_dir).select("id", "kind", "status", "merged_id", "parent_id", "text")


def timeline_stats(spark, sf_dir):
    """The composed list's counts, summed and elapsed time by session and kind."""
    return _composed(spark, sf_dir).groupBy("session_id", "kind").agg(F.count("*").alias("n"), F.count("end_us").alias("closed"), F.sum(F.col("end_us") - F.col("start_us")).alias("sum_us"), (F.max(F.coalesce("end_us", "start_us")) - F.min("start_us")).alias("elapsed_us"))


def timeline_search(spark, sf_dir):
    """What of the composed list is a tool and has a text in name or text, whatever its case."""
    rows = _composed(spark, sf_dir).where(F.col("kind") == "tool")
    return rows.where(F.contains(F.lower(F.concat("status", F.lit("\n"), "text")), F.lower(F.lit("View 1")))).select("id", "status", "text")


QUERIES = {f.__name__: f for f in (otlp_any_values, span_identities, span_sessions, bucket_sessions, record_classes, item_times, producers, timeline_composed, timeline_stats, timeline_search)}

_SESSIONS = f"""WITH RECURSIVE {SPANS}, up AS (SELECT trace_id, span_id, span_id AS at, direct AS found, parent_span_id AS nx FROM identified UNION ALL SELECT u.trace_id, u.span_id, i.span_id, i.direct, i.parent_span_id FROM up u JOIN identified i ON i.trace_id = u.trace_id AND i.span_id = u.nx WHERE u.found IS NULL),
near AS (SELECT trace_id, span_id, any_value(found) AS nearest FROM up WHERE found IS NOT NULL GROUP BY ALL), only_one AS (SELECT trace_id, min(c) AS c FROM (SELECT trace_id, unnest(candidates) AS c FROM identified) GROUP BY trace_id HAVING count(DISTINCT c) = 1),
owned AS (SELECT i.trace_id, i.span_id, coalesce(direct, nearest, o.c, i.trace_id::VARCHAR) AS session_id, CASE WHEN direct IS NOT NULL THEN basis WHEN nearest IS NOT NULL THEN 'ancestor span conversation identity' WHEN o.c IS NOT NULL THEN 'unique conversation identity in trace' ELSE 'unattributed trace' END AS basis
  FROM identified i LEFT JOIN near n ON n.trace_id = i.trace_id AND n.span_id = i.span_id LEFT JOIN only_one o ON o.trace_id = i.trace_id)"""
_K = f"WITH {TRACE_EVENTS}, e AS (SELECT *, json_extract_string(attributes, '$.k')::INT AS k FROM trace_events)"
_COMPOSED = f"""{_K}, x AS (SELECT *, k // 50 AS turn, CASE WHEN k % 11 <> 0 THEN k END AS call, CASE WHEN id % 4 = 0 THEN k - 1 END AS pcall, kind || ' ' || k AS text, CASE WHEN kind IN ('click', 'view') THEN 'tool' ELSE 'user_wait' END AS what FROM e),
calls AS (SELECT * FROM x WHERE kind IN ('click', 'purchase')), items AS (SELECT *, count(*) OVER (PARTITION BY session_id, turn, call) AS same FROM x WHERE kind IN ('view', 'error')),
g AS (SELECT session_id, turn, call, count(*) AS n, min(id) AS cid, arg_min(what, id) AS cwhat, arg_min(text, id) AS ctext FROM calls WHERE call IS NOT NULL GROUP BY ALL),
j AS (SELECT i.*, g.n, g.cid, g.ctext, g.cwhat, p.cid AS parent FROM items i LEFT JOIN g ON g.session_id = i.session_id AND g.turn = i.turn AND g.call = i.call LEFT JOIN g p ON p.session_id = i.session_id AND p.turn = i.turn AND p.call = i.pcall AND p.n = 1),
s AS (SELECT *, CASE WHEN parent IS NOT NULL THEN 'child' WHEN n = 1 AND same = 1 AND cwhat = what AND end_us IS NOT NULL THEN 'matched' WHEN n > 0 THEN 'ambiguous' ELSE 'unmatched' END AS status FROM j),
m AS (SELECT cid, id FROM s WHERE status = 'matched'),
composed AS (SELECT session_id, s.id, what AS kind, status, CASE WHEN status = 'matched' THEN s.cid END AS merged_id, coalesce(m.id, parent) AS parent_id, start_us, end_us, CASE WHEN status = 'matched' THEN ctext ELSE text END AS text FROM s LEFT JOIN m ON m.cid = s.parent
  UNION ALL SELECT session_id, id, what, 'unmatched', NULL, NULL, start_us, end_us, text FROM calls WHERE id NOT IN (SELECT cid FROM m))"""

SQL = {
    "otlp_any_values": f"{_K} SELECT id, x.n AS name, x.t AS type, x.v AS value FROM (SELECT id, unnest([{{'n': 'kind', 't': 'string', 'v': kind}}, {{'n': 'k', 't': 'int', 'v': k::VARCHAR}}, {{'n': 'open', 't': 'bool', 'v': (end_us IS NULL)::VARCHAR}}, {{'n': 'half', 't': 'double', 'v': k || '.5'}}, {{'n': 'list', 't': 'array', 'v': '{{\"values\":[' || k || ']}}'}}, {{'n': 'of.source', 't': 'string', 'v': source}}, {{'n': 'of.n', 't': 'int', 'v': k::VARCHAR}}]) AS x FROM e)",
    "span_identities": f"WITH {SPANS} SELECT trace_id, span_id, direct, basis, array_to_string(candidates, '|') AS candidates FROM identified",
    "span_sessions": f"{_SESSIONS} SELECT * FROM owned",
    "bucket_sessions": f"{_SESSIONS} SELECT session_id, count(*) AS n FROM owned GROUP BY session_id HAVING count(*) = count(*) FILTER (session_id = trace_id::VARCHAR)",
    "record_classes": f"""{_K}, r AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'traces' ELSE 'logs' END AS signal, ['agent.api_request', 'agent.tool_result', 'agent.user_prompt', 'agent.sse_event', 'run_tool', 'mcp.request_user_input'][k % 6 + 1] AS name, CASE k % 5 WHEN 1 THEN 'chat' WHEN 2 THEN 'execute_tool' ELSE '' END AS op, CASE k % 9 WHEN 0 THEN 'shell' WHEN 1 THEN 'ui.request_user_input' END AS tool,
  k % 20 >= 17 OR k % 8 = 0 OR k % 3 = 2 AS failed, start_us * 1000 AS t0, end_us * 1000 AS e, CASE WHEN k % 4 <> 0 THEN (k - 5) * 0.5::DOUBLE END AS d FROM e),
c AS (SELECT *, CASE WHEN signal = 'traces' THEN CASE WHEN tool IS NOT NULL OR op = 'execute_tool' OR lower(name) LIKE '%tool%' THEN 'tool' WHEN op = 'chat' OR name = 'agent.api_request' THEN 'llm' ELSE 'event' END
  ELSE CASE name WHEN 'agent.tool_result' THEN 'tool' WHEN 'agent.api_request' THEN 'llm' WHEN 'agent.user_prompt' THEN 'user' ELSE 'event' END END AS kind0 FROM r),
t AS (SELECT *, signal = 'logs' AND d IS NOT NULL AND kind0 IN ('tool', 'llm') AS timed FROM c)
SELECT id, CASE WHEN coalesce(tool, name) LIKE '%.request_user_input' AND (kind0 = 'tool' OR signal = 'traces') THEN 'user_wait' ELSE kind0 END AS kind, CASE WHEN failed THEN 'error' ELSE 'ok' END AS status, CASE WHEN timed AND d >= 0 THEN t0 - floor(d * 1000000)::BIGINT ELSE t0 END AS start_ns, CASE WHEN timed AND d >= 0 THEN t0 WHEN signal = 'traces' THEN e END AS end_ns,
  CASE WHEN timed AND d < 0 THEN 'invalid' WHEN timed OR signal = 'traces' AND e IS NOT NULL THEN 'measured' ELSE 'unknown' END AS timing FROM t""",
    "item_times": f"{_K}, i AS (SELECT id, kind = 'click' AND (k % 3 = 0 OR k % 5 = 0) AS reported, start_us // 1000 AS a, end_us // 1000 AS b, CASE WHEN k % 3 = 0 THEN k ELSE 0 END * 1000000000::BIGINT + CASE WHEN k % 5 = 0 THEN k * 1000 ELSE 0 END AS len FROM e) SELECT id, CASE WHEN b IS NOT NULL THEN CASE WHEN reported THEN b * 1000000 - len ELSE a * 1000000 END END AS start_ns, b * 1000000 AS end_ns FROM i",
    "producers": "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' OR o_orderstatus = 'P' THEN 'self' END AS producer, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderstatus <> 'P' THEN o_custkey::VARCHAR END AS inherited_from FROM orders",
    "timeline_composed": f"{_COMPOSED} SELECT id, kind, status, merged_id, parent_id, text FROM composed",
    "timeline_stats": f"{_COMPOSED} SELECT session_id, kind, count(*) AS n, count(end_us) AS closed, sum(end_us - start_us)::BIGINT AS sum_us, max(coalesce(end_us, start_us)) - min(start_us) AS elapsed_us FROM composed GROUP BY ALL",
    "timeline_search": f"{_COMPOSED} SELECT id, status, text FROM composed WHERE kind = 'tool' AND contains(lower(status || chr(10) || text), 'view 1')",
}
