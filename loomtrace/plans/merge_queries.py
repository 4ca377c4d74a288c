"""Queries of merges, lineage and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions.variants import json_set
from loomtrace.operators import lineage, merge, splits
from loomtrace.sources.storage import table
from loomtrace.sources.views import TRACE_EVENTS, trace_events


def event_upsert(spark, sf_dir):
    """Two thirds of the events as stored, two thirds as delivered again: errors are tools then, waits in the delivery."""
    e = trace_events(spark, sf_dir).withColumn("text", F.when(F.col("id") % 5 == 0, "").otherwise(F.col("attributes")))
    stored = e.where("id % 3 != 0").withColumn("kind", F.when(F.col("kind") == "error", "tool").otherwise(F.col("kind")))
    incoming = e.where("id % 3 != 1").withColumns({"kind": F.when(F.col("kind") == "error", "user_wait").otherwise(F.col("kind")), "end_us": F.coalesce("end_us", F.col("start_us") + 1), "text": F.col("attributes")})
    return merge.upsert_events(stored, incoming)


def json_path_set(spark, sf_dir):
    """Events' properties with one path set: below what is there, beside it, through a plain value (no change), and for new parents."""
    e = table(spark, sf_dir, "events")
    doc = F.concat(F.lit('{"a": {"b": '), F.get_json_object("props", "$.k"), F.lit(', "l": [1]}, "t": "'), F.col("event_type"), F.lit('"}'))
    value = F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]"))
    k = F.col("event_id") % 4
    new = F.when(k == 0, json_set(doc, ["a", "b"], value)).when(k == 1, json_set(doc, ["a", "z"], value)).when(k == 2, json_set(doc, ["t", "x"], value)).otherwise(json_set(doc, ["n", "m"], value))
    return e.select("event_id", new.alias("doc"))


def scope_correction(spark, sf_dir):
    """Events as stored and delivered again with an input scope; of some the name differs, others aren't of a kind that asks."""
    e = trace_events(spark, sf_dir).withColumns({"source": F.when(F.col("id") % 5 == 0, "otlp_log").otherwise("codex_jsonl"), "text": F.lit("x"), "name": F.lit("ask")})
    kind = F.when(F.col("kind") == "error", "tool").when(F.col("kind") == "click", "user_wait").otherwise(F.col("kind"))
    scope = F.when(F.col("id") % 3 == 0, F.lit('{"wait_type":"input_request"}')).when(F.col("id") % 3 == 1, F.lit('{"input_scope":"human"}'))
    stored = e.select("session_id", "id", "source", "name", "text", "start_us", kind.alias("kind"), scope.alias("attributes"))
    incoming = e.where("id % 7 != 0").select("session_id", "id", "source", F.when(F.col("id") % 11 == 0, "other").otherwise(F.col("name")).alias("name"), "text", "start_us", F.when(F.col("id") % 2 == 0, "event").otherwise("user_wait").alias("kind"), F.when(F.col("id") % 13 != 0, F.when(F.col("id") % 2 == 0, "internal").otherwise("human")).alias("input_scope"))
    return merge.correct_scopes(stored, incoming).select("session_id", "id", "kind", "attributes", "corrected")


def _documents(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    deep = F.struct(F.struct(F.struct(F.struct(F.col("o_custkey").alias("f")).alias("e")).alias("d/c")).alias("b"))
    inner = F.struct(F.col("o_orderpriority").alias("agent"), F.struct(F.col("o_custkey").alias("id")).alias("user"), deep.alias("deep"), F.array(F.col("o_orderstatus"), F.lit("x")).alias("tags"))
    return o.select("o_orderkey", F.to_json(F.struct(inner.alias("meta"), F.col("o_orderkey").alias("key"))).alias("doc"))


def field_lineage(spark, sf_dir):
    """Every leaf of each order's metadata with the origin of its nearest described parent."""
    said = spark.createDataFrame([("", "normalized"), ("/meta", "calculated"), ("/meta/user/id", "inferred"), ("/meta/tags", "unknown")], "pointer string, origin string")
    return lineage.described(lineage.leaves(_documents(spark, sf_dir), "o_orderkey", "doc"), "o_orderkey", said)


def split_search(spark, sf_dir):
    """Documents' sources as groups, dealt by the best of 512 seeds."""
    g = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("group_id")).agg(F.count("*").alias("n"))
    return splits.best_deal(g)


QUERIES = {f.__name__: f for f in (event_upsert, field_lineage, split_search, json_path_set, scope_correction)}

_DEAL = "CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'validation' ELSE 'test' END"

SQL = {
    "json_path_set": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"a":{"b":[' || event_id || '],"l":[1]},"t":"' || event_type || '"}' WHEN 1 THEN '{"a":{"b":' || (props->>'$.k') || ',"l":[1],"z":[' || event_id || ']},"t":"' || event_type || '"}'
  WHEN 2 THEN '{"a":{"b":' || (props->>'$.k') || ',"l":[1]},"t":"' || event_type || '"}' ELSE '{"a":{"b":' || (props->>'$.k') || ',"l":[1]},"n":{"m":[' || event_id || ']},"t":"' || event_type || '"}' END AS doc FROM events""",
    "scope_correction": f"""WITH {TRACE_EVENTS}, s AS (SELECT session_id, id, id % 5 <> 0 AND id % 7 <> 0 AND id % 11 <> 0 AND id % 13 <> 0 AS same, CASE WHEN kind = 'error' THEN 'tool' WHEN kind = 'click' THEN 'user_wait' ELSE kind END AS kind,
  CASE id % 3 WHEN 0 THEN '{{"wait_type":"input_request"}}' WHEN 1 THEN '{{"input_scope":"human"}}' END AS attributes, CASE id % 3 WHEN 1 THEN 'human' END AS scope, CASE WHEN id % 2 = 0 THEN 'event' ELSE 'user_wait' END AS nk, CASE WHEN id % 2 = 0 THEN 'internal' ELSE 'human' END AS ns FROM trace_events),
c AS (SELECT *, same AND (kind IN ('tool', 'user_wait') OR id % 3 = 0) AND (kind <> nk OR scope IS DISTINCT FROM ns) AS corrected FROM s)
SELECT session_id, id, CASE WHEN corrected THEN nk ELSE kind END AS kind, CASE WHEN NOT corrected THEN attributes WHEN id % 3 = 0 THEN '{{"input_scope":"' || ns || '","wait_type":"input_request"}}' ELSE '{{"input_scope":"' || ns || '"}}' END AS attributes, corrected FROM c""",
    "event_upsert": f"""WITH {TRACE_EVENTS}, s AS (SELECT session_id, id, CASE WHEN kind = 'error' THEN 'tool' ELSE kind END AS kind, start_us, end_us, CASE WHEN id % 5 = 0 THEN '' ELSE attributes END AS text FROM trace_events WHERE id % 3 <> 0),
i AS (SELECT session_id, id, CASE WHEN kind = 'error' THEN 'user_wait' ELSE kind END AS kind, start_us, coalesce(end_us, start_us + 1) AS end_us, attributes AS text FROM trace_events WHERE id % 3 <> 1)
SELECT coalesce(s.session_id, i.session_id) AS session_id, coalesce(s.id, i.id) AS id, CASE WHEN s.kind = 'tool' AND i.kind = 'user_wait' THEN i.kind ELSE coalesce(s.kind, i.kind) END AS kind, coalesce(s.start_us, i.start_us) AS start_us, coalesce(s.end_us, i.end_us) AS end_us,
  CASE WHEN s.id IS NULL THEN i.text WHEN s.text = '' AND i.text <> '' THEN i.text ELSE s.text END AS text,
  CASE WHEN s.id IS NULL THEN 'inserted' WHEN i.id IS NULL THEN 'kept' WHEN s.end_us IS NULL THEN 'closed' WHEN s.kind = 'tool' AND i.kind = 'user_wait' THEN 'corrected' WHEN s.text = '' AND i.text <> '' THEN 'filled' ELSE 'kept' END AS change
FROM s FULL OUTER JOIN i ON s.id = i.id AND s.session_id = i.session_id""",
    "field_lineage": """WITH l AS (SELECT o_orderkey, unnest([{'p': '/meta/agent', 'v': '"' || o_orderpriority || '"', 'o': 'calculated'}, {'p': '/meta/user/id', 'v': o_custkey::VARCHAR, 'o': 'inferred'}, {'p': '/meta/tags/0', 'v': '"' || o_orderstatus || '"', 'o': 'unknown'}, {'p': '/meta/tags/1', 'v': '"x"', 'o': 'unknown'}, {'p': '/meta/deep/b/d~1c/e/f', 'v': o_custkey::VARCHAR, 'o': 'calculated'}, {'p': '/key', 'v': o_orderkey::VARCHAR, 'o': 'normalized'}]) AS x FROM orders)
SELECT DISTINCT o_orderkey, x.p AS pointer, x.v AS value, x.o AS origin FROM l""",
    "split_search": f"""WITH g AS (SELECT source AS group_id, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT group_id, n, seed, ('0x' || substr(md5(seed || ':' || group_id), 1, 8))::BIGINT % 100 AS h FROM g, range(512) r(seed)), d AS (SELECT *, {_DEAL} AS split FROM t),
c AS (SELECT seed, sum(n) AS total, coalesce(sum(n) FILTER (split = 'train'), 0) AS a, coalesce(sum(n) FILTER (split = 'validation'), 0) AS b, coalesce(sum(n) FILTER (split = 'test'), 0) AS e FROM d GROUP BY seed),
best AS (SELECT seed FROM c ORDER BY least(a, b, e) = 0, abs(a * 100 - total * 70) + abs(b * 100 - total * 15) + abs(e * 100 - total * 15), seed LIMIT 1) SELECT group_id, n, seed::INT AS seed, split FROM d JOIN best USING (seed)""",
}
