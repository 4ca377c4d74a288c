"""Queries over captures, re-imports, raw links, findings and times."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtrace.functions.text import strict_nanos
from loomtrace.operators import captures as C
from loomtrace.sources.storage import table
from loomtrace.sources.views import TRACE_EVENTS, trace_events


def _captures(spark, sf_dir):
    """Orders as captures; their lines as outcomes, of which some are errors."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("capture_id"), F.col("o_orderpriority").alias("source"))
    li = table(spark, sf_dir, "lineitem").where("l_linenumber > 1")
    outcomes = li.select(F.col("l_orderkey").alias("capture_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("sequence"), F.col("l_partkey").alias("result"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("bad "), "l_linestatus")).alias("error"))
    return C.with_outcome(o, outcomes)


def capture_status(spark, sf_dir):
    return _captures(spark, sf_dir)


def capture_page(spark, sf_dir):
    """Thirty captures after the hundredth key, with the cursor for the next page."""
    return C.page(_captures(spark, sf_dir), "capture_id", 100, 30).select("capture_id", "status", "next_cursor")


def import_summary(spark, sf_dir):
    """Captures as imported files by source: failed ones, those that changed nothing, and what the others added."""
    c = _captures(spark, sf_dir)
    added = F.when(F.col("status") == "normalized", F.col("result") % 4).otherwise(0)
    return c.groupBy("source").agg(F.count("*").alias("files"), F.count_if(F.col("status") == "failed").alias("failures"), F.count_if((F.col("status") == "normalized") & (added == 0)).alias("no_change"), F.sum(added).alias("new_events"), F.count_distinct(F.col("capture_id") % 50).alias("sessions"))


def payload_chunks(spark, sf_dir):
    """Pieces of 4,096 bytes of every text, as an export sends them."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return C.chunks(d, "doc_id", 4096)


def snapshot_reconciliation(spark, sf_dir):
    """Events derived from users' files that come again: some lines missing, some rows anew, and files of some users with another line."""
    e = trace_events(spark, sf_dir).withColumn("k", F.get_json_object("attributes", "$.k").cast("int"))
    e = e.withColumn("sequence", F.row_number().over(Window.partitionBy("session_id").orderBy("start_us", "id")))
    e = e.withColumn("n", F.count("*").over(Window.partitionBy("session_id")))
    stored = e.where("k % 5 != 0").select("session_id", "id", "sequence", F.col("kind").alias("value"))
    came = e.where("sequence * 3 <= n * 2 AND k % 7 != 0")
    incoming = came.select("session_id", "id", "sequence", F.when(F.col("k") % 4 == 0, F.concat("kind", F.lit("!"))).otherwise(F.col("kind")).alias("value"))
    lines = lambda rows, text: rows.select("session_id", "sequence", F.sha2(text, 256).alias("sha256"))
    old = lines(e, F.col("attributes"))
    new = lines(came, F.when((F.col("session_id") % 6 == 0) & (F.col("k") == 33), "other").otherwise(F.col("attributes")))
    return C.reconciled(stored, incoming, old, new)


def event_raw_links(spark, sf_dir):
    """Events with the raw lines they came from, where the event still is what the lines say and isn't inferred."""
    e = trace_events(spark, sf_dir)
    k = F.get_json_object("attributes", "$.k").cast("int")
    events = e.select("id", F.col("kind").alias("value"), F.when(k % 6 == 0, "estimated").otherwise("measured").alias("timing"))
    links = e.select(F.col("id").alias("event_id"), F.col("session_id").alias("import_id"), F.when(k % 3 == 0, F.array("id", F.col("id") + 1)).otherwise(F.array("id")).alias("sequences"), F.when(k % 10 == 0, "older").otherwise(F.col("kind")).alias("normalized"))
    lines = e.select(F.col("session_id").alias("import_id"), F.col("id").alias("sequence"), F.sha2("attributes", 256).alias("sha256"))
    return C.raw_links(links, events, lines)


def producer_changes(spark, sf_dir):
    """Customers as sessions whose producer orders set or clear."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.when(F.col("c_nationkey") % 2 == 0, "own").alias("producer"), F.col("c_nationkey").cast("long").alias("evidence"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("sequence"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("producer"))
    return C.produced(c, o)


def session_lookup(spark, sf_dir):
    """One session with its newest event and sorted tags."""
    e = trace_events(spark, sf_dir).where("session_id = 7")
    return e.groupBy("session_id").agg(F.max_by("id", F.struct("start_us", "id")).alias("newest"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("tags"))


def identity_histogram(spark, sf_dir):
    """Sessions by kind of identity, with the total that pages are counted by."""
    c = table(spark, sf_dir, "customer").groupBy(F.when(F.col("c_acctbal") < 0, "trace").otherwise("session").alias("identity_kind")).agg(F.count("*").alias("n"))
    return c.withColumn("total", F.sum("n").over(Window.partitionBy()))


def latency_ranks(spark, sf_dir):
    """Median and 95th percentile of each kind's durations, as the value at place n div 2 and at round half even((n - 1) * 0.95), and at its floor."""
    e = trace_events(spark, sf_dir).where("end_us IS NOT NULL").select("kind", (F.col("end_us") - F.col("start_us")).alias("us"))
    n = e.groupBy("kind", "us").agg(F.count("*").alias("n"))
    w = Window.partitionBy("kind")
    upto = n.withColumns({"upto": F.sum("n").over(w.orderBy("us")), "total": F.sum("n").over(w)})
    at = {"median_us": F.floor(F.col("total") / 2), "p95_us": F.bround((F.col("total") - 1) * 0.95, 0).cast("long"), "p95_floor_us": F.floor((F.col("total") - 1) * 0.95)}
    has = lambda place: F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("n") <= place), F.col("us")))
    return upto.groupBy("kind").agg(*(has(p).alias(k) for k, p in at.items()))


def quote_occurrences(spark, sf_dir):
    """Every place where a text has a quote, overlapping ones too."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return C.occurrences(d, "doc_id", "ere").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("start").alias("last"))


def merged_findings(spark, sf_dir):
    """Line items as findings in a text an order is: spans by quantity, two categories; what is kept, contained or in conflict."""
    li = table(spark, sf_dir, "lineitem")
    start = (F.col("l_partkey") % 60).cast("int")
    spans = li.select(F.col("l_orderkey").alias("text_id"), start.alias("start"), (start + 1 + F.col("l_quantity").cast("int") % 20).alias("end"), F.when(F.col("l_suppkey") % 3 == 0, "name").otherwise("place").alias("category"))
    return C.merged_findings(spans, "text_id").groupBy("text_id", "state").agg(F.count("*").alias("n"))


def strict_times(spark, sf_dir):
    """Nanoseconds of events' times written in several forms, of which some are refused."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k % 5 == 0, F.concat(base, F.lit("Z"))).when(k % 5 == 1, F.concat(base, F.lit(".123456789+02:00"))).when(k % 5 == 2, base).when(k % 5 == 3, F.concat(base, F.lit(".5z"))).otherwise(F.concat(base, F.lit(".1234567890Z")))
    return e.select("event_id", strict_nanos(text).alias("ns"))


def wall_times(spark, sf_dir):
    """Milliseconds that tool output reports, where it does."""
    e = table(spark, sf_dir, "events")
    said = F.when(F.col("event_type") == "click", F.concat(F.lit("ok\nWALL TIME: "), F.get_json_object("props", "$.k"), F.lit(".25 seconds"))).when(F.col("event_type") == "view", F.lit("Wall time: 1.2.3 seconds")).otherwise(F.lit("none"))
    return e.select("event_id", C.wall_ms(said).alias("ms"))


QUERIES = {f.__name__: f for f in (capture_status, capture_page, import_summary, payload_chunks, snapshot_reconciliation, event_raw_links, producer_changes, session_lookup, identity_histogram, latency_ranks, quote_occurrences, merged_findings, strict_times, wall_times)}

_K = f"WITH {TRACE_EVENTS}, e AS (SELECT *, json_extract_string(attributes, '$.k')::INT AS k FROM trace_events)"
_CAPTURES = """WITH o AS (SELECT l_orderkey AS capture_id, arg_max((l_partkey, CASE WHEN l_returnflag = 'R' THEN 'bad ' || l_linestatus END), (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS o FROM lineitem WHERE l_linenumber > 1 GROUP BY 1),
c AS (SELECT o_orderkey AS capture_id, o_orderpriority AS source, CASE WHEN o.capture_id IS NULL THEN 'pending' WHEN o.o[2] IS NOT NULL THEN 'failed' ELSE 'normalized' END AS status, o.o[1] AS result, o.o[2] AS error FROM orders LEFT JOIN o ON o.capture_id = o_orderkey)"""

SQL = {
    "capture_status": f"{_CAPTURES} SELECT * FROM c",
    "capture_page": f"{_CAPTURES}, p AS (SELECT *, row_number() OVER (ORDER BY capture_id) AS n, count(*) OVER () AS total FROM c WHERE capture_id > 100) SELECT capture_id, status, CASE WHEN total > 30 THEN (SELECT capture_id FROM p WHERE n = 30) END AS next_cursor FROM p WHERE n <= 30",
    "import_summary": f"{_CAPTURES}, a AS (SELECT *, CASE WHEN status = 'normalized' THEN result % 4 ELSE 0 END AS added FROM c) SELECT source, count(*) AS files, count(*) FILTER (status = 'failed') AS failures, count(*) FILTER (status = 'normalized' AND added = 0) AS no_change, sum(added)::BIGINT AS new_events, count(DISTINCT capture_id % 50) AS sessions FROM a GROUP BY source",
    "payload_chunks": "WITH d AS (SELECT doc_id, encode(text) AS b FROM documents WHERE strlen(text) > 0), x AS (SELECT doc_id, b, unnest(range(0, (octet_length(b) + 4095) // 4096)) AS chunk FROM d), y AS (SELECT doc_id, chunk::INT AS chunk, b[chunk * 4096 + 1 : chunk * 4096 + 4096] AS p FROM x) SELECT doc_id, chunk, octet_length(p)::INT AS length, sha256(p) AS sha256 FROM y",
    "snapshot_reconciliation": f"""{_K}, q AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_us, id) AS sequence, count(*) OVER (PARTITION BY session_id) AS n FROM e), s AS (SELECT session_id, id, sequence, kind AS was FROM q WHERE k % 5 <> 0), came AS (SELECT * FROM q WHERE sequence * 3 <= n * 2 AND k % 7 <> 0),
i AS (SELECT session_id, id, CASE WHEN k % 4 = 0 THEN kind || '!' ELSE kind END AS now FROM came), bad AS (SELECT DISTINCT session_id FROM came WHERE session_id % 6 = 0 AND k = 33), u AS (SELECT session_id, max(sequence) AS upto FROM came GROUP BY 1),
j AS (SELECT coalesce(s.session_id, i.session_id) AS session_id, coalesce(s.id, i.id) AS id, s.id IS NOT NULL AS had, i.id IS NOT NULL AS came, sequence, was, now FROM s FULL JOIN i ON s.session_id = i.session_id AND s.id = i.id),
r AS (SELECT j.*, CASE WHEN b.session_id IS NOT NULL THEN CASE WHEN had THEN 'conflict' END WHEN had AND NOT came THEN CASE WHEN sequence <= upto THEN 'deleted' ELSE 'kept' END WHEN NOT had THEN 'inserted' WHEN was IS NOT DISTINCT FROM now THEN 'unchanged' ELSE 'updated' END AS change FROM j LEFT JOIN bad b USING (session_id) LEFT JOIN u USING (session_id))
SELECT session_id, id, change, CASE WHEN change IN ('inserted', 'updated') THEN now ELSE was END AS value FROM r WHERE change IS NOT NULL""",
    "event_raw_links": f"{_K}, l AS (SELECT id AS event_id, session_id AS import_id, unnest(CASE WHEN k % 3 = 0 THEN [id, id + 1] ELSE [id] END) AS sequence FROM e WHERE k % 6 <> 0 AND k % 10 <> 0) SELECT event_id, import_id, sequence, sha256(attributes) AS sha256 FROM l JOIN e ON e.session_id = import_id AND e.id = sequence",
    "producer_changes": "WITH o AS (SELECT o_custkey, arg_max((CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END,), o_orderkey) AS c FROM orders GROUP BY 1) SELECT c_custkey AS session_id, CASE WHEN c IS NOT NULL THEN c[1] WHEN c_nationkey % 2 = 0 THEN 'own' END AS producer, CASE WHEN c IS NOT NULL AND c[1] IS NULL THEN 0 ELSE c_nationkey END::BIGINT AS evidence FROM customer LEFT JOIN o ON o_custkey = c_custkey",
    "session_lookup": f"{_K} SELECT session_id, arg_max(id, (start_us, id)) AS newest, array_to_string(list_sort(list(DISTINCT kind)), ',') AS tags FROM e WHERE session_id = 7 GROUP BY session_id",
    "identity_histogram": "SELECT CASE WHEN c_acctbal < 0 THEN 'trace' ELSE 'session' END AS identity_kind, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS total FROM customer GROUP BY 1",
    "latency_ranks": f"{_K}, r AS (SELECT kind, end_us - start_us AS us, row_number() OVER (PARTITION BY kind ORDER BY end_us - start_us) - 1 AS place, count(*) OVER (PARTITION BY kind) AS n FROM e WHERE end_us IS NOT NULL) SELECT kind, max(us) FILTER (place = n // 2) AS median_us, max(us) FILTER (place = round_even((n - 1) * 0.95, 0)::BIGINT) AS p95_us, max(us) FILTER (place = floor((n - 1) * 0.95)) AS p95_floor_us FROM r GROUP BY kind",
    "quote_occurrences": "WITH p AS (SELECT doc_id, text, unnest(range(1, length(text) - 1)) AS i FROM documents WHERE contains(text, 'ere')) SELECT doc_id, count(*) AS n, min(i - 1)::INT AS first, max(i - 1)::INT AS last FROM p WHERE substr(text, i, 3) = 'ere' GROUP BY doc_id",
    "merged_findings": """WITH s AS (SELECT DISTINCT l_orderkey AS text_id, (l_partkey % 60)::INT AS a, (l_partkey % 60 + 1 + l_quantity::INT % 20)::INT AS b, CASE WHEN l_suppkey % 3 = 0 THEN 'name' ELSE 'place' END AS category FROM lineitem),
h AS (SELECT *, max((b, category)) OVER (PARTITION BY text_id ORDER BY a, b DESC, category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM s)
SELECT text_id, CASE WHEN NOT coalesce(a < h[1], false) THEN 'kept' WHEN b <= h[1] AND category = h[2] THEN 'contained' ELSE 'conflict' END AS state, count(*) AS n FROM h GROUP BY ALL""",
    "strict_times": "WITH e AS (SELECT event_id, json_extract_string(props, '$.k')::INT AS k, epoch(date_trunc('second', ts))::BIGINT AS s FROM events) SELECT event_id, CASE k % 5 WHEN 0 THEN s * 1000000000 WHEN 1 THEN (s - 7200) * 1000000000 + 123456789 WHEN 3 THEN s * 1000000000 + 500000000 END AS ns FROM e",
    "wall_times": "SELECT event_id, CASE WHEN event_type = 'click' THEN (json_extract_string(props, '$.k') || '.25')::DOUBLE * 1000 END AS ms FROM events",
}
