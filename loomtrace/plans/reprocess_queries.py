"""Queries of trace exports in either form and of stored payloads read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import otlp, reprocess, rollout
from loomtrace.plans.rollout_queries import RECORDS
from loomtrace.sources import rollout as source
from loomtrace.sources.storage import table
from loomtrace.sources.views import TRACE_EVENTS, trace_events

#: Spans of an export, as an exporter sends them.
EXPORT = 50


def _exports(spark, sf_dir):
    """Events as trace exports of at most EXPORT spans: JSON bodies with the user as their resource."""
    e = trace_events(spark, sf_dir)
    pair = lambda k, **v: F.struct(F.lit(k).alias("key"), F.struct(*[x.alias(n) for n, x in v.items()]).alias("value"))
    hexed = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    span = lambda x: F.to_json(F.struct(
        hexed(F.col("session_id"), 32).alias("traceId"), hexed(x["id"], 16).alias("spanId"), F.when(x["id"] % 3 == 0, hexed(x["id"] + 1, 16)).alias("parentSpanId"), x["kind"].alias("name"),
        (x["start_us"] * 1000).cast("string").alias("startTimeUnixNano"), (x["end_us"] * 1000).cast("string").alias("endTimeUnixNano"),
        F.array(pair("source", stringValue=x["source"])).alias("attributes"), F.when(x["kind"] == "error", F.struct(F.lit(2).alias("code"))).alias("status"),
    ))
    # events are dealt as they are: their JSON is several times longer
    parts = e.withColumn("part", F.floor(F.col("id") / EXPORT)).groupBy("session_id", "part").agg(F.sort_array(F.collect_list(F.struct("id", "kind", "source", "start_us", "end_us"))).alias("s"))
    resource = F.concat(F.lit('{"attributes": [{"key": "user.id", "value": {"intValue": "'), F.col("session_id").cast("string"), F.lit('"}}]}'))
    spans = F.array_join(F.transform("s", span), ",")
    body = F.concat(F.lit('{"resourceSpans": [{"resource": '), resource, F.lit(', "scopeSpans": [{"scope": {"name": "made"}, "spans": ['), spans, F.lit("]}]}]}"))
    return parts.select(F.concat(F.lit("u"), F.col("session_id").cast("string"), F.lit("-"), F.col("part").cast("string")).alias("capture_id"), "session_id", "part", body.alias("body"))


def _captured(spark, sf_dir):
    """Exports as captures: every second in the binary form, and of those every fifth part cut off at its last byte."""
    made = _exports(spark, sf_dir)
    odd = F.pmod("session_id", F.lit(2)) == 1
    # known before the bodies are made: each form is made of its own events alone
    wire = otlp.encoded(made.where(odd)).withColumn("content_type", F.lit(otlp.BINARY))
    part = F.regexp_extract("capture_id", "([0-9]+)$", 1).cast("long")
    cut = F.when(part % 5 == 4, F.expr("substring(content, 1, octet_length(content) - 1)")).otherwise(F.col("content"))
    plain = made.where(~odd).select("capture_id", F.lit("application/json").alias("content_type"), F.col("body").cast("binary").alias("content"))
    return wire.select("capture_id", "content_type", cut.alias("content")).unionByName(plain)


def otlp_binary(spark, sf_dir):
    """Spans of exports in both forms; a body that was cut off is refused whole."""
    return otlp.spans(otlp.decoded(_captured(spark, sf_dir))).select("capture_id", "sequence", "trace_id", "span_id", "parent_span_id", "name", "start_ns", "end_ns", "status_code", F.col("resource")["user.id"].alias("user"), "scope_name", F.col("record")["source"].alias("source"))


def reprocessed_captures(spark, sf_dir):
    """Rollouts, exports and payloads of unknown sources, read again. Before, a rule lost waits of rollouts, and exports of even parts weren't captured yet."""
    lines = source.derived_lines(spark, sf_dir)
    texts = lines.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line_number", "line"))).alias("l"))  # a conversation's own lines
    # one session in ten was cut off inside its last record
    whole = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    text = F.when(F.endswith("file", F.lit("3")), F.concat(whole, F.lit("\n{"))).otherwise(whole)
    rolls = texts.select(F.col("file").alias("capture_id"), F.lit("rollout").alias("source"), F.lit("application/jsonl").alias("content_type"), text.cast("binary").alias("content"))
    exports = _captured(spark, sf_dir).select("capture_id", F.lit("otlp_traces").alias("source"), "content_type", "content")
    other = table(spark, sf_dir, "supplier").select(F.concat(F.lit("x"), F.col("s_suppkey").cast("string")).alias("capture_id"), F.lit("metrics").alias("source"), F.lit("text/plain").alias("content_type"), F.col("s_name").cast("binary").alias("content"))
    captures = rolls.unionByName(exports).unionByName(other).withColumn("encoding", F.lit("identity"))
    old = rollout.events(source.records(lines), with_file=True).where("kind != 'user_wait'")
    before = reprocess.digests(old, "file", reprocess.EVENT).select(F.col("file").alias("capture_id"), "digest")
    sent = otlp.spans(_exports(spark, sf_dir).where("part % 2 = 1").select("capture_id", "body"))
    before = before.unionByName(reprocess.digests(sent, "capture_id", reprocess.SPAN).select("capture_id", "digest"))
    return reprocess.reprocessed(captures, before, 1 << 24)


QUERIES = {f.__name__: f for f in (otlp_binary, reprocessed_captures)}

_SPANS = f"""{TRACE_EVENTS}, sent AS (SELECT *, 'u' || session_id || '-' || (id // {EXPORT}) AS capture_id, id // {EXPORT} AS part FROM trace_events),
spans AS (SELECT capture_id, session_id, part, row_number() OVER (PARTITION BY capture_id ORDER BY id) - 1 AS sequence, lpad(lower(to_hex(session_id)), 32, '0') AS trace_id, lpad(lower(to_hex(id)), 16, '0') AS span_id,
  CASE WHEN id % 3 = 0 THEN lpad(lower(to_hex(id + 1)), 16, '0') END AS parent_span_id, kind AS name, start_us * 1000 AS start_ns, end_us * 1000 AS end_ns, CASE WHEN kind = 'error' THEN '2' ELSE '0' END AS status_code, source,
  session_id % 2 = 1 AND part % 5 = 4 AS cut FROM sent)"""


def _digest(columns: tuple[str, ...]) -> str:
    text = " || '|' || ".join(f"coalesce('=' || {c}::VARCHAR, '-')" for c in columns)
    return f"sum(('0x' || substr(md5({text}), 1, 15))::BIGINT::HUGEINT)"


SQL = {
    "otlp_binary": f"WITH {_SPANS} SELECT capture_id, sequence::INT AS sequence, trace_id, span_id, parent_span_id, name, start_ns::BIGINT AS start_ns, end_ns::BIGINT AS end_ns, status_code, session_id::VARCHAR AS user, 'made' AS scope_name, source FROM spans WHERE NOT cut",
    "reprocessed_captures": f"""WITH {_SPANS}, {RECORDS},
d AS (SELECT file AS capture_id, count(*) AS n, {_digest(reprocess.EVENT)} AS digest FROM events GROUP BY 1), old AS (SELECT file AS capture_id, {_digest(reprocess.EVENT)} AS earlier FROM events WHERE kind <> 'user_wait' GROUP BY 1),
files AS (SELECT DISTINCT file AS capture_id, file LIKE '%3' AS bad FROM lines),
x AS (SELECT capture_id, any_value(cut) AS bad, any_value(part) % 2 = 1 AS had, count(*) AS n, {_digest(reprocess.SPAN)} AS digest FROM spans GROUP BY 1),
found AS (SELECT capture_id, 'rollout' AS source, CASE WHEN bad THEN 'refused by its reader' END AS error, n, digest, earlier FROM files LEFT JOIN d USING (capture_id) LEFT JOIN old USING (capture_id)
  UNION ALL SELECT capture_id, 'otlp_traces', CASE WHEN bad THEN 'ValueError: refused' END, n, digest, CASE WHEN had THEN digest END FROM x
  UNION ALL SELECT 'x' || s_suppkey, 'metrics', 'no reader for the source', NULL, NULL, NULL FROM supplier)
SELECT capture_id, source, CASE WHEN error IS NULL THEN 'normalized' ELSE 'failed' END AS status, error, CASE WHEN error IS NULL THEN coalesce(n, 0) END AS n, CASE WHEN error IS NULL THEN coalesce(digest, 0)::DECIMAL(38,0) END AS digest,
  CASE WHEN error IS NULL THEN CASE WHEN earlier IS NULL THEN 'new' WHEN earlier = coalesce(digest, 0) THEN 'same' ELSE 'changed' END END AS change FROM found""",
}
