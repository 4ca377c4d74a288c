"""Queries over rollouts derived from conversations: events, their evidence, archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import intervals, lineage, rollout
from loomtrace.sources import rollout as source
from loomtrace.sources.storage import written
from loomtrace.sources.views import turns


def _events(spark, sf_dir):
    return rollout.events(source.records(source.derived_lines(spark, sf_dir)))


def rollout_events(spark, sf_dir):
    return _events(spark, sf_dir)


def rollout_stats(spark, sf_dir):
    """Per kind and timing: events, summed and active time over all sessions."""
    e = _events(spark, sf_dir).withColumn("id", F.col("line_number"))
    by = intervals.measure(e, ["session_id", "kind", "timing"])
    return by.groupBy("kind", "timing").agg(F.sum("n").alias("n"), F.sum("sum_ms").alias("sum_ms"), F.sum("active_ms").alias("active_ms"))


def field_evidence(spark, sf_dir):
    """How many fields of events, and values in lines they are from, by kind of event, field and use."""
    found = rollout.evidence(source.records(source.derived_lines(spark, sf_dir)))
    each = found.select("kind", F.col("pointer").alias("field"), "origin", F.explode_outer("sources").alias("s"))
    return each.groupBy("kind", "field", "origin", F.col("s.pointer").alias("place"), F.col("s.use").alias("use")).agg(F.count("*").alias("n"), F.sum("s.line").alias("lines"))


def _edited(lines):
    """Lines as an archive may have them later: some outputs and names changed, some lines gone."""
    k = F.col("line_number")
    line = F.when(k % 7 == 0, F.regexp_replace("line", "seconds", "minutes")).when(k % 11 == 0, F.regexp_replace("line", '"call_id"', '"old_id"')).otherwise(F.col("line"))
    return lines.where(k % 13 != 0).withColumn("line", line)


def evidence_states(spark, sf_dir):
    """Evidence saved at import against lines that were edited since: what of it still holds, by field and state."""
    # read several times, and each would write the rollouts anew
    lines = written(source.derived_lines(spark, sf_dir), "lines")
    saved = lineage.saved(rollout.evidence(source.records(lines)), lines)
    archives = lines.where("NOT endswith(file, '7')").select("file").distinct()
    return lineage.checked(saved, _edited(lines), archives).groupBy("field", "state").agg(F.count("*").alias("n"))


def event_support(spark, sf_dir):
    """Leaves of events with the evidence of their fields, by field: how many have any, and how many rest on a line that no longer holds."""
    # read several times, and each would write and decode the rollouts anew
    lines = written(source.derived_lines(spark, sf_dir), "lines")
    records = written(source.records(lines), "records")
    key = F.concat_ws("|", "session_id", "line_number", "kind").alias("event")
    events = rollout.events(records).select(key, F.to_json(F.struct("session_id", "line_number", "turn_id", "kind", "name", "start_us", "end_us", "timing", "status"), {"ignoreNullFields": "false"}).alias("doc"))
    events = written(events, "events")
    held = lineage.checked(lineage.saved(rollout.evidence(records), lines), _edited(lines), lines.select("file").distinct()).select(key, "field", "origin", "place", "state")
    found = lineage.supported(lineage.leaves(events, "event", "doc"), "event", held)
    return found.groupBy("pointer", "origin").agg(F.count("*").alias("n"), F.sum("sources").alias("sources"), F.count_if(F.col("broken") > 0).alias("broken"))


def raw_line_archive(spark, sf_dir):
    """Each rollout's lines, bytes and content digest."""
    return source.archived(source.derived_lines(spark, sf_dir))


def raw_line_versions(spark, sf_dir):
    """Archives of rollouts delivered when they had half their lines, whole, and whole again: equal content under one mapping is one version."""
    lines = source.derived_lines(spark, sf_dir)
    n = lines.groupBy("file").agg(F.max("line_number").alias("n"))
    half = lines.join(n, "file").where("line_number * 2 <= n").drop("n")
    whole = source.archived(lines)
    sent = [source.archived(half).withColumn("delivery", F.lit(1)), whole.withColumn("delivery", F.lit(2)), whole.withColumn("delivery", F.lit(3))]
    sent = sent[0].unionByName(sent[1]).unionByName(sent[2]).withColumnRenamed("file", "session_id").withColumn("mapping", F.when(F.col("line_count") % 5 == 0, F.col("delivery").cast("string")).otherwise("1"))
    return source.versions(sent).select("session_id", "sha256", "mapping", "delivery", "deliveries", "version")


def prompt_mirrors(spark, sf_dir):
    """User turns said twice, as an event and as an item, one event in seven reworded: the copies go."""
    t = turns(spark, sf_dir).where("role = 'user'").select("session_id", F.col("index").alias("task"), "text")
    event = F.struct(F.pmod("task", F.lit(4)).alias("line_number"), F.lit("event_msg").alias("source"), F.when(F.length("text") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    item = F.struct(F.lit(1).cast("long").alias("line_number"), F.lit("response_item").alias("source"), F.col("text"))
    said = t.select("session_id", "task", F.inline(F.array(event, item)))
    return rollout.without_mirrors(said).groupBy("session_id", "source").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (rollout_events, rollout_stats, field_evidence, evidence_states, event_support, raw_line_archive, raw_line_versions, prompt_mirrors)}
_LINES = """turns AS (SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text, turn FROM conversations),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM turns),
p AS (SELECT conv_id, n, unnest(CASE WHEN role = 'system' THEN [{'k': 0, 's': 0, 'y': 'response_item', 'j': '{"type":"message","role":"system","text":' || to_json(text)::VARCHAR || '}'}]
  WHEN role = 'user' THEN [{'k': 0, 's': 0, 'y': 'event_msg', 'j': '{"type":"task_started","turn_id":"t' || ((n + 1) // 2) || '"}'}, {'k': 1, 's': 1, 'y': 'response_item', 'j': '{"type":"message","role":"user","text":' || to_json(text)::VARCHAR || '}'}]
  ELSE CASE WHEN n % 4 < 3 THEN [{'k': 2, 's': 2, 'y': 'response_item', 'j': '{"type":"function_call","call_id":"c' || n || '","name":"' || CASE WHEN n % 8 = 0 THEN 'request_user_input' ELSE 'shell' END || '","arguments":"{}"}'},
      {'k': 3, 's': 9, 'y': 'response_item', 'j': '{"type":"function_call_output","call_id":"' || CASE WHEN n % 6 <> 0 THEN 'c' || n ELSE 'lost' END || '","output":"' || CASE WHEN n % 10 = 0 THEN 'Process exited with code 2' ELSE 'Wall time: 5.5 seconds' END || '"}'}] ELSE [] END
    || [{'k': 5, 's': 20, 'y': 'response_item', 'j': '{"type":"message","role":"assistant","phase":"final_answer","text":' || to_json(text)::VARCHAR || '}'}, {'k': 6, 's': 21, 'y': 'event_msg', 'j': '{"type":"task_complete","turn_id":"t' || ((n + 1) // 2) || '"}'}] END) AS r FROM t),
lines AS (SELECT 'conv-' || conv_id AS file, 2 + row_number() OVER (PARTITION BY conv_id ORDER BY n, r.k) AS line_number,
    '{"timestamp":"' || strftime(make_timestamp(1700000000000000 + conv_id * 86400000000 + n * 60000000 + r.s * 1000000), '%Y-%m-%dT%H:%M:%S.%fZ') || '","type":"' || r.y || '","payload":' || r.j || '}' AS line FROM p
  UNION ALL SELECT DISTINCT 'conv-' || conv_id, 1, '{"timestamp":"2023-11-14T00:00:00Z","type":"session_meta","payload":{"id":"' || conv_id || '"}}' FROM conversations UNION ALL SELECT DISTINCT 'conv-' || conv_id, 2, '' FROM conversations)"""


def _archive(lines: str) -> str:
    return f"""SELECT file, sum(n)::BIGINT AS line_count, (sum(size) + sum(n))::BIGINT AS byte_count, sha256(string_agg(h, '' ORDER BY block)) AS sha256 FROM (
  SELECT file, (line_number - 1) // 1000 AS block, count(*) AS n, sum(strlen(line)) AS size, sha256(string_agg(sha256(line), '' ORDER BY line_number)) AS h FROM {lines} GROUP BY ALL) GROUP BY file"""


RECORDS = _LINES + r""",
recs AS (SELECT file, line_number, line, epoch_us(replace(replace(line->>'$.timestamp', 'Z', ''), 'T', ' ')::TIMESTAMP) AS at_us, line->>'$.type' AS y, line->>'$.payload.type' AS kind, line->>'$.payload.role' AS role,
    line->>'$.payload.phase' AS phase, line->>'$.payload.id' AS id, line->>'$.payload.turn_id' AS tid, line->>'$.payload.call_id' AS call_id, line->>'$.payload.name' AS nm, line->>'$.payload.output' AS outp
  FROM (SELECT file, line_number, CASE WHEN trim(line) = '' THEN '{}' ELSE line END AS line FROM lines WHERE trim(line) <> '')),
whats AS (SELECT *, CASE WHEN y = 'response_item' AND kind = 'function_call' THEN 'call' WHEN y = 'response_item' AND kind = 'function_call_output' THEN 'output'
    WHEN y = 'response_item' AND kind = 'message' AND role = 'user' THEN 'asked' WHEN y = 'response_item' AND kind = 'message' AND coalesce(role, '') NOT IN ('developer', 'system') THEN 'said'
    WHEN y = 'event_msg' AND kind = 'task_started' THEN 'started' WHEN y = 'event_msg' AND kind IN ('task_complete', 'turn_aborted') THEN 'ended' END AS what FROM recs),
calls AS (SELECT file, line_number, lead(what) OVER c AS next_what, lead(line_number) OVER c AS next_line, lead(at_us) OVER c AS next_at, lead(outp) OVER c AS next_output, lag(what) OVER c AS former
  FROM whats WHERE what IN ('call', 'output') WINDOW c AS (PARTITION BY file, call_id ORDER BY line_number)),
acts AS (SELECT *, CASE WHEN what IN ('asked', 'started') THEN 1 WHEN what = 'ended' OR (what = 'said' AND phase = 'final_answer') THEN 0 END AS act,
    CASE WHEN what = 'call' AND coalesce(former, '') <> 'call' THEN 1 WHEN what = 'output' AND former = 'call' THEN -1 ELSE 0 END AS opened FROM whats LEFT JOIN calls USING (file, line_number)),
state AS (SELECT *, max(CASE WHEN y = 'session_meta' THEN id END) OVER f AS session_id, max(CASE WHEN y = 'session_meta' THEN line_number END) OVER f AS session_line,
    last_value(CASE WHEN what = 'started' THEN tid END IGNORE NULLS) OVER upto AS turn_id, last_value(CASE WHEN what = 'started' THEN line_number END IGNORE NULLS) OVER upto AS turn_line,
    coalesce(last_value(act IGNORE NULLS) OVER upto, 0) AS active, sum(opened) OVER upto AS open_calls
  FROM acts WINDOW f AS (PARTITION BY file), upto AS (PARTITION BY file ORDER BY line_number ROWS UNBOUNDED PRECEDING)),
words AS (SELECT *, CASE WHEN what IN ('asked', 'started') THEN line_number WHEN what IN ('call', 'ended') THEN 0 WHEN what = 'output' THEN CASE WHEN active = 1 AND open_calls = 0 THEN line_number ELSE 0 END
      WHEN what = 'said' THEN CASE WHEN active = 1 THEN line_number ELSE 0 END END AS anchors,
    CASE WHEN (what = 'said' AND phase = 'final_answer') OR (what = 'ended' AND kind = 'task_complete') THEN line_number WHEN what IN ('asked', 'call', 'said', 'ended') THEN 0 END AS waits FROM state),
before AS (SELECT *, nullif(last_value(anchors IGNORE NULLS) OVER b, 0) AS anchor_line, nullif(last_value(waits IGNORE NULLS) OVER b, 0) AS waiting_line, coalesce(lag(active) OVER o, 0) AS was_active, coalesce(lag(open_calls) OVER o, 0) AS were_open
  FROM words WINDOW o AS (PARTITION BY file ORDER BY line_number), b AS (PARTITION BY file ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT b.*, x.at_us AS anchor, w.at_us AS waiting FROM before b LEFT JOIN recs x ON x.file = b.file AND x.line_number = anchor_line LEFT JOIN recs w ON w.file = b.file AND w.line_number = waiting_line WHERE what IS NOT NULL AND session_id IS NOT NULL),
made AS (SELECT *, unnest(list_filter([
    CASE WHEN what IN ('call', 'said') AND was_active = 1 AND were_open = 0 AND at_us > anchor THEN {'kind': 'llm', 'name': 'LLM response (estimated)', 'a': anchor, 'b': at_us, 'timing': 'estimated', 'status': 'ok', 'begun': anchor_line} END,
    CASE WHEN what = 'asked' AND at_us > waiting THEN {'kind': 'user_wait', 'name': 'Between turns (inferred user wait)', 'a': waiting, 'b': at_us, 'timing': 'estimated', 'status': 'ok', 'begun': waiting_line} END,
    CASE WHEN what = 'asked' THEN {'kind': 'user', 'name': 'User input', 'a': at_us, 'b': NULL, 'timing': 'unknown', 'status': 'ok', 'begun': NULL} END,
    CASE WHEN what = 'said' THEN {'kind': 'assistant', 'name': 'Assistant', 'a': at_us, 'b': NULL, 'timing': 'unknown', 'status': 'ok', 'begun': NULL} END,
    CASE WHEN what = 'call' AND next_what = 'output' THEN {'kind': CASE WHEN nm = 'request_user_input' THEN 'user_wait' ELSE 'tool' END, 'name': nm, 'a': at_us, 'b': greatest(at_us, next_at), 'timing': 'estimated', 'status': CASE WHEN regexp_matches(next_output, '[Ee]xited with code [1-9]') THEN 'error' ELSE 'ok' END, 'begun': NULL} END,
    CASE WHEN what = 'call' AND next_what IS NULL THEN {'kind': CASE WHEN nm = 'request_user_input' THEN 'user_wait' ELSE 'tool' END, 'name': nm, 'a': at_us, 'b': NULL, 'timing': 'unknown', 'status': 'incomplete', 'begun': NULL} END,
    CASE WHEN what = 'output' AND coalesce(former, '') <> 'call' THEN {'kind': 'event', 'name': 'Unmatched tool output', 'a': at_us, 'b': NULL, 'timing': 'unknown', 'status': 'incomplete', 'begun': NULL} END,
    CASE WHEN what = 'ended' THEN {'kind': 'event', 'name': kind, 'a': at_us, 'b': NULL, 'timing': 'unknown', 'status': CASE WHEN kind = 'task_complete' THEN 'ok' ELSE 'interrupted' END, 'begun': NULL} END
  ], lambda x: x IS NOT NULL)) AS e FROM marked),
events AS (SELECT file, session_id, line_number, turn_id, what, session_line, turn_line, e.begun AS begun, CASE WHEN what = 'call' AND next_what = 'output' AND e.begun IS NULL THEN next_line END AS result, what = 'call' AND e.begun IS NULL AS tool,
    e.kind AS kind, e.name AS name, e.a AS start_us, e.b AS end_us, e.timing AS timing, e.status AS status FROM made)"""
_EVIDENCE = RECORDS + r""",
uses AS (SELECT file, session_id, line_number, kind, unnest([
    {'f': '/session_id', 'o': 'normalized', 's': [{'l': session_line, 'p': '/payload/id', 'u': 'value'}]},
    {'f': '/line_number', 'o': 'calculated', 's': [{'l': line_number, 'p': '', 'u': 'physical_line'}]},
    {'f': '/turn_id', 'o': CASE WHEN turn_line IS NULL THEN 'inferred' ELSE 'normalized' END, 's': [{'l': turn_line, 'p': '/payload/turn_id', 'u': 'context'}]},
    {'f': '/kind', 'o': 'inferred', 's': [{'l': line_number, 'p': '/type', 'u': 'classification'}, {'l': line_number, 'p': '/payload/type', 'u': 'classification'}, {'l': CASE WHEN tool THEN line_number END, 'p': '/payload/name', 'u': 'classification'},
      {'l': CASE WHEN what IN ('asked', 'said') THEN line_number END, 'p': '/payload/role', 'u': 'classification'}, {'l': begun, 'p': '/timestamp', 'u': 'interval_start'}, {'l': CASE WHEN begun IS NOT NULL THEN line_number END, 'p': '/timestamp', 'u': 'interval_end'}]},
    {'f': '/name', 'o': CASE WHEN tool THEN 'normalized' ELSE 'inferred' END, 's': [{'l': CASE WHEN tool THEN line_number END, 'p': '/payload/name', 'u': 'value'}, {'l': CASE WHEN NOT tool THEN line_number END, 'p': '/type', 'u': 'classification'}, {'l': CASE WHEN NOT tool THEN line_number END, 'p': '/payload/type', 'u': 'classification'}]},
    {'f': '/start_us', 'o': 'normalized', 's': [{'l': begun, 'p': '/timestamp', 'u': 'interval_start'}, {'l': CASE WHEN begun IS NULL THEN line_number END, 'p': '/timestamp', 'u': 'value'}]},
    {'f': '/end_us', 'o': CASE WHEN result IS NOT NULL THEN 'calculated' WHEN begun IS NOT NULL THEN 'normalized' ELSE 'inferred' END, 's': [{'l': CASE WHEN begun IS NOT NULL THEN line_number END, 'p': '/timestamp', 'u': 'interval_end'}, {'l': CASE WHEN result IS NOT NULL THEN line_number END, 'p': '/timestamp', 'u': 'value'}, {'l': result, 'p': '/timestamp', 'u': 'result'}]},
    {'f': '/timing', 'o': 'inferred', 's': [{'l': begun, 'p': '/timestamp', 'u': 'interval_start'}, {'l': CASE WHEN begun IS NOT NULL THEN line_number END, 'p': '/timestamp', 'u': 'interval_end'}, {'l': CASE WHEN result IS NOT NULL THEN line_number END, 'p': '/payload/call_id', 'u': 'pairing'}, {'l': result, 'p': '/payload/call_id', 'u': 'pairing'}]},
    {'f': '/status', 'o': 'inferred', 's': [{'l': result, 'p': '/payload/output', 'u': 'value'}, {'l': CASE WHEN (tool AND result IS NULL) OR what = 'output' THEN line_number END, 'p': '/payload/call_id', 'u': 'pairing'}, {'l': CASE WHEN what = 'ended' THEN line_number END, 'p': '/payload/type', 'u': 'classification'}]}
  ]) AS x FROM events),
fields AS (SELECT file, session_id, line_number, kind, x.f AS field, x.o AS origin, list_filter(x.s, lambda y: y.l IS NOT NULL) AS sources FROM uses),
sources AS (SELECT file, session_id, line_number, kind, field, origin, unnest(CASE WHEN len(sources) = 0 THEN [NULL] ELSE sources END) AS s FROM fields)"""
_CHECKED = """,
edited AS (SELECT file, line_number, CASE WHEN line_number % 7 = 0 THEN replace(line, 'seconds', 'minutes') WHEN line_number % 11 = 0 THEN replace(line, '"call_id"', '"old_id"') ELSE line END AS now FROM lines WHERE line_number % 13 <> 0 AND line <> ''),
sound AS (SELECT * FROM lines WHERE line <> ''),
both_lines AS (SELECT s.*, l.line AS was, d.now FROM sources s LEFT JOIN sound l ON l.file = s.file AND l.line_number = s.s.l LEFT JOIN edited d ON d.file = s.file AND d.line_number = s.s.l),
valued AS (SELECT *, CASE WHEN s.p = '' THEN sha256(was) ELSE was->>s.p END AS seen, CASE WHEN s.p = '' THEN sha256(now) ELSE now->>s.p END AS found FROM both_lines)"""

SQL = {
    "rollout_events": f"WITH {RECORDS} SELECT session_id, line_number, turn_id, kind, name, start_us, end_us, timing, status FROM events",
    "rollout_stats": f"""WITH {RECORDS}, closed AS (SELECT session_id, kind, timing, start_us AS a, end_us AS b FROM events WHERE end_us > start_us),
o AS (SELECT *, max(b) OVER (PARTITION BY session_id, kind, timing ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM closed),
g AS (SELECT kind, timing, sum(greatest(0, b - greatest(a, coalesce(reach, a)))) AS active FROM o GROUP BY ALL), n AS (SELECT kind, timing, count(*) AS n, sum(end_us - start_us) AS total FROM events GROUP BY ALL)
SELECT kind, timing, n, total / 1000.0 AS sum_ms, active / 1000.0 AS active_ms FROM n LEFT JOIN g USING (kind, timing)""",
    "field_evidence": f"WITH {_EVIDENCE} SELECT kind, field, origin, s.p AS place, s.u AS use, count(*) AS n, sum(s.l)::BIGINT AS lines FROM sources GROUP BY ALL",
    "evidence_states": f"""WITH {_EVIDENCE}{_CHECKED} SELECT field, CASE WHEN s IS NULL THEN 'no source' WHEN file LIKE '%7' THEN 'no archive' WHEN now IS NULL THEN 'no line' WHEN found IS NULL AND seen IS NOT NULL THEN 'unresolved'
  WHEN found IS NOT DISTINCT FROM seen THEN 'ok' ELSE 'changed' END AS state, count(*) AS n FROM valued GROUP BY ALL""",
    "event_support": f"""WITH {_EVIDENCE}{_CHECKED}, e AS (SELECT session_id, line_number, kind, field, origin, count(s) AS sources, count(*) FILTER (s IS NOT NULL AND (now IS NULL OR found IS DISTINCT FROM seen)) AS broken FROM valued GROUP BY ALL)
SELECT field AS pointer, origin, count(*) AS n, sum(sources)::BIGINT AS sources, count(*) FILTER (broken > 0) AS broken FROM e GROUP BY ALL""",
    "raw_line_archive": f"WITH {_LINES} {_archive('lines')}",
    "raw_line_versions": f"""WITH {_LINES}, halves AS (SELECT file, line_number, line FROM (SELECT *, max(line_number) OVER (PARTITION BY file) AS n FROM lines) WHERE line_number * 2 <= n), w AS ({_archive('lines')}),
sent AS (SELECT *, 1 AS delivery FROM ({_archive('halves')}) UNION ALL SELECT *, 2 FROM w UNION ALL SELECT *, 3 FROM w), m AS (SELECT *, CASE WHEN line_count % 5 = 0 THEN delivery::VARCHAR ELSE '1' END AS mapping FROM sent),
f AS (SELECT file AS session_id, sha256, mapping, min(delivery)::INT AS delivery, count(*) AS deliveries FROM m GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY delivery, mapping, sha256)::INT AS version FROM f""",
    "prompt_mirrors": "SELECT conv_id AS session_id, source, count(*) AS n FROM (SELECT conv_id, unnest(CASE WHEN length(text) % 7 = 0 THEN ['event_msg', 'response_item'] ELSE ['response_item'] END) AS source FROM conversations WHERE role = 'user') GROUP BY ALL",
}
