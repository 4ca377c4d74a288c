"""Queries over labels, joins, embeddings and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import labels as L
from loomtrace.operators import lineage
from loomtrace.operators import merge as M
from loomtrace.operators import similarity as S
from loomtrace.operators.graph import dealt_anew
from loomtrace.sources.storage import table
from loomtrace.sources.views import TRACE_EVENTS, trace_events
from loomtrace.streaming.daily import daily_counts


#: Rows that one JSON document holds at most.
BATCH = 1000


def _pairs(spark, sf_dir):
    """Quality as the truth, a length rule as the prediction."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 500).cast("int").alias("predicted"))
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("actual")).join(d, "doc_id")


def confusion_matrix(spark, sf_dir):
    return L.confusion(_pairs(spark, sf_dir), [0, 1])


def prediction_metrics(spark, sf_dir):
    return L.metrics(_pairs(spark, sf_dir), [0, 1])


def label_coverage(spark, sf_dir):
    return L.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["quality", "toxic"])


def paired_subset(spark, sf_dir):
    """Two rules compared on the documents that both can judge."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").where("n_chars IS NOT NULL AND lang IS NOT NULL AND quality IN (0, 1)")
    a, b = (F.col("n_chars") >= 500).cast("int"), (F.col("lang") == "en").cast("int")
    return rows.agg(F.count("*").alias("n"), F.count_if(a == F.col("quality")).alias("first_right"), F.count_if(b == F.col("quality")).alias("second_right"), F.count_if(a == b).alias("agree"))


def alignment(spark, sf_dir):
    """insufficient, agreement or disagreement by distinct valid values over two labels."""
    row = F.array_distinct(F.filter(F.array("quality", "toxic"), lambda x: x.isin(0, 1)))
    state = F.when(F.size(F.filter(F.array("quality", "toxic"), lambda x: x.isin(0, 1))) < 2, "insufficient").when(F.size(row) == 1, "agreement").otherwise("disagreement")
    return table(spark, sf_dir, "labels").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def set_difference(spark, sf_dir):
    """Documents without a label: a left anti join."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


def not_exists_chain(spark, sf_dir):
    """Customers without a pending order whose nation has no supplier in debt."""
    c, o, s = (table(spark, sf_dir, x) for x in ("customer", "orders", "supplier"))
    rest = c.join(o.where("o_orderstatus = 'P'"), c.c_custkey == o.o_custkey, "left_anti")
    return rest.join(s.where("s_acctbal < -500"), rest.c_nationkey == s.s_nationkey, "left_anti").select("c_custkey")


def snapshot_conflict_semi(spark, sf_dir):
    """Orders that a customer has on a day on which it has another of a different price: key equal, price not."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    spread = o.groupBy("o_custkey", "day").agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high")).where("low != high")
    return o.join(dealt_anew(spread, "o_custkey"), ["o_custkey", "day"], "left_semi").select("o_orderkey")


def session_list_page(spark, sf_dir):
    """A page of customers by (balance descending, key): name match, total and offset."""
    rows = table(spark, sf_dir, "customer").where(F.contains(F.lower("c_name"), F.lit("customer#")) & ~F.col("c_mktsegment").eqNullSafe("MACHINERY"))
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(F.desc("c_acctbal"), "c_custkey").offset(20).limit(20)
    return page.crossJoin(F.broadcast(total)).select("c_custkey", "c_name", "c_acctbal", "total")  # one row of totals


def unified_compose(spark, sf_dir):
    """Clicks with the view of the same user and k, where both are the only ones."""
    e = trace_events(spark, sf_dir).withColumn("k", F.get_json_object("attributes", "$.k").cast("int"))
    left = e.where("kind = 'click'").select("id", "session_id", "k")
    right = e.where("kind = 'view'").select(F.col("id").alias("right_id"), "session_id", "k")
    return M.unique_matches(left, right, ["session_id", "k"])


def trace_attribution(spark, sf_dir):
    """Line items as spans of their order; those of part keys divisible by 50 name their supplier."""
    li = table(spark, sf_dir, "lineitem")
    spans = li.select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_orderkey").alias("trace_id"), F.when(F.col("l_partkey") % 50 == 0, F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("identity"))
    found = M.attribute_traces(spans)
    return found.groupBy("owner", "basis").agg(F.count("*").alias("n"))


def session_upsert_fold(spark, sf_dir):
    """Customers as sessions, their orders as deliveries in key order."""
    o = table(spark, sf_dir, "orders")
    title = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.col("o_custkey").cast("string"))
    rows = o.select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("sequence"), title.alias("title"), F.to_date("o_orderdate").cast("string").alias("started_at"), F.when(F.col("o_orderkey") % 10 == 0, "session").otherwise("trace").alias("identity_kind"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("producer"))
    return M.fold_sessions(rows)


def unit_vectors(spark, sf_dir):
    """Squared length of the unit vectors and their first component."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", S.unit("embedding").alias("u"))
    return v.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"), F.round(F.col("u")[0], 6).alias("first"))


def cosine_pairs(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), S.unit("embedding").alias("vector"))
    return S.cosine_pairs(v, 0.4)


def json_leaves(spark, sf_dir):
    """Pointer, type and value of every leaf of the events' properties."""
    return lineage.leaves(table(spark, sf_dir, "events"), "event_id", "props")


def otlp_flatten(spark, sf_dir):
    """Spans out of nested OTLP JSON, a batch a user: resource, scope and span levels exploded, attributes as a map."""
    e = trace_events(spark, sf_dir)
    attribute = F.array(F.struct(F.lit("kind").alias("key"), F.struct(F.col("kind").alias("stringValue")).alias("value")), F.struct(F.lit("source").alias("key"), F.struct(F.col("source").alias("stringValue")).alias("value")))
    span = F.struct(F.col("id").cast("string").alias("spanId"), (F.col("start_us") * 1000).cast("string").alias("startTimeUnixNano"), attribute.alias("attributes"))
    # a batch has a bounded number of spans, as an exporter sends them
    users = e.withColumn("batch", F.floor(F.monotonically_increasing_id() / BATCH)).groupBy("session_id", "batch", "source").agg(F.collect_list(span).alias("spans"))
    scopes = users.groupBy("session_id", "batch").agg(F.collect_list(F.struct("spans")).alias("scopeSpans"))
    body = scopes.select(F.to_json(F.struct(F.array(F.struct(F.struct(F.col("session_id").cast("string").alias("id")).alias("resource"), "scopeSpans")).alias("resourceSpans"))).alias("body"))
    kv = "ARRAY<STRUCT<key: STRING, value: STRUCT<stringValue: STRING>>>"
    schema = f"resourceSpans ARRAY<STRUCT<resource: STRUCT<id: STRING>, scopeSpans: ARRAY<STRUCT<spans: ARRAY<STRUCT<spanId: STRING, startTimeUnixNano: STRING, attributes: {kv}>>>>>>"
    r = body.select(F.explode(F.from_json("body", schema)["resourceSpans"]).alias("r"))
    s = r.select("r.resource", F.explode("r.scopeSpans").alias("s")).select("resource", F.explode("s.spans").alias("span"))
    attributes = F.map_from_entries(F.transform("span.attributes", lambda a: F.struct(a["key"], a["value"]["stringValue"])))
    return s.select(F.col("resource.id").cast("long").alias("session_id"), F.col("span.spanId").cast("long").alias("id"), F.col("span.startTimeUnixNano").cast("long").alias("start_ns"), attributes["kind"].alias("kind"), attributes["source"].alias("source"))


def label_import(spark, sf_dir):
    """Saved label results, a JSON document a source, in parts of bounded size, opened to one row a turn and model; unknown categories count as invalid."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    said = F.create_map(F.lit("m1"), F.when(F.col("quality") == 1, "good").otherwise("poor"), F.lit("m2"), F.when(F.col("toxic") == 1, "odd").otherwise("good"))
    saved = rows.groupBy("source", F.floor(F.monotonically_increasing_id() / BATCH).alias("part")).agg(F.to_json(F.struct(F.collect_list(F.struct("doc_id", said.alias("classifications"))).alias("turn_results"))).alias("body"))
    rows = saved.select("source", F.explode(F.from_json("body", "turn_results ARRAY<STRUCT<doc_id: BIGINT, classifications: MAP<STRING, STRING>>>")["turn_results"]).alias("r"))
    rows = rows.select("source", "r.doc_id", F.explode("r.classifications").alias("model", "category"))
    return rows.select("doc_id", "model", "category", F.col("category").isin("good", "poor").alias("valid"))


def stream_daily_counts(spark, sf_dir):
    return daily_counts(spark, f"{sf_dir}/events.parque[t]")  # as a pattern: a file stream takes one file so


QUERIES = {f.__name__: f for f in (confusion_matrix, prediction_metrics, label_coverage, paired_subset, alignment, set_difference, not_exists_chain, snapshot_conflict_semi, session_list_page, unified_compose, trace_attribution, session_upsert_fold, unit_vectors, cosine_pairs, json_leaves, otlp_flatten, label_import, stream_daily_counts)}

_PAIRS = "pairs AS (SELECT quality AS actual, (n_chars >= 500)::INT AS predicted FROM labels JOIN documents USING (doc_id)), grid AS (SELECT a AS actual, p AS predicted FROM (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(p)), m AS (SELECT g.actual, g.predicted, count(pairs.actual) AS n FROM grid g LEFT JOIN pairs ON pairs.actual = g.actual AND pairs.predicted = g.predicted GROUP BY ALL)"
_UNIT = "u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM u)"

SQL = {
    "confusion_matrix": f"WITH {_PAIRS} SELECT actual, predicted, n FROM m",
    "prediction_metrics": f"""WITH {_PAIRS}, c AS (SELECT k AS class, (SELECT sum(n) FROM m WHERE actual = k)::BIGINT AS support, (SELECT sum(n) FROM m WHERE predicted = k)::BIGINT AS guessed, (SELECT sum(n) FROM m WHERE actual = k AND predicted = k)::BIGINT AS hits FROM (VALUES (0), (1)) x(k)),
f AS (SELECT class, support, hits, CASE WHEN guessed > 0 THEN hits / guessed::DOUBLE ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support::DOUBLE ELSE 0 END AS recall, CASE WHEN support + guessed > 0 THEN 2.0::DOUBLE * hits / (support + guessed) ELSE 0 END AS f1 FROM c)
SELECT class, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round((sum(hits) OVER ())::DOUBLE / (sum(support) OVER ()), 9) AS accuracy, round(avg(f1) OVER (), 9) AS macro_f1, round(sum(f1 * support) OVER () / (sum(support) OVER ()), 9) AS weighted_f1 FROM f""",
    "label_coverage": "WITH j AS (SELECT d.doc_id, l.doc_id AS there, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)), x AS (SELECT 'quality' AS configuration, there, quality AS v FROM j UNION ALL SELECT 'toxic', there, toxic FROM j) SELECT configuration, count(*) FILTER (v IN (0, 1)) AS available, count(*) FILTER (v NOT IN (0, 1)) AS invalid, count(*) FILTER (v IS NULL) AS missing FROM x GROUP BY configuration",
    "paired_subset": "SELECT count(*) AS n, count(*) FILTER ((n_chars >= 500)::INT = quality) AS first_right, count(*) FILTER ((lang = 'en')::INT = quality) AS second_right, count(*) FILTER ((n_chars >= 500) = (lang = 'en')) AS agree FROM labels JOIN documents USING (doc_id) WHERE n_chars IS NOT NULL AND lang IS NOT NULL AND quality IN (0, 1)",
    "alignment": "SELECT CASE WHEN NOT (quality IN (0, 1) AND toxic IN (0, 1)) OR quality IS NULL OR toxic IS NULL THEN 'insufficient' WHEN quality = toxic THEN 'agreement' ELSE 'disagreement' END AS state, count(*) AS n FROM labels GROUP BY 1",
    "set_difference": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "not_exists_chain": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal < -500)",
    "snapshot_conflict_semi": "SELECT o_orderkey FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderdate::DATE = a.o_orderdate::DATE AND b.o_totalprice <> a.o_totalprice)",
    "session_list_page": "WITH r AS (SELECT * FROM customer WHERE lower(c_name) LIKE '%customer#%' AND c_mktsegment IS DISTINCT FROM 'MACHINERY') SELECT c_custkey, c_name, c_acctbal, (SELECT count(*) FROM r) AS total FROM r ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 20",
    "unified_compose": f"WITH {TRACE_EVENTS}, e AS (SELECT *, json_extract_string(attributes, '$.k')::INT AS k FROM trace_events), l AS (SELECT id, session_id, k, count(*) OVER (PARTITION BY session_id, k) AS ln FROM e WHERE kind = 'click'), r AS (SELECT session_id, k, count(*) AS rn, min(id) AS rid FROM e WHERE kind = 'view' GROUP BY ALL) SELECT id, l.session_id, l.k, CASE WHEN rn IS NULL THEN 'unmatched' WHEN ln = 1 AND rn = 1 THEN 'matched' ELSE 'ambiguous' END AS match, CASE WHEN ln = 1 AND rn = 1 THEN rid END AS right_id FROM l LEFT JOIN r ON r.session_id = l.session_id AND r.k = l.k",
    "trace_attribution": "WITH s AS (SELECT l_orderkey AS t, CASE WHEN l_partkey % 50 = 0 THEN 's' || l_suppkey END AS i FROM lineitem), o AS (SELECT t, min(i) AS a, max(i) AS b FROM s WHERE i IS NOT NULL GROUP BY t) SELECT coalesce(i, CASE WHEN a = b THEN a END, 'trace:' || s.t) AS owner, CASE WHEN i IS NOT NULL THEN 'direct' WHEN a = b THEN 'only identity in trace' ELSE 'trace' END AS basis, count(*) AS n FROM s LEFT JOIN o ON o.t = s.t GROUP BY ALL",
    "session_upsert_fold": "SELECT o_custkey AS session_id, coalesce(arg_max(o_orderpriority, o_orderkey) FILTER (o_orderkey % 3 = 0), o_custkey::VARCHAR) AS title, min(o_orderdate::DATE)::VARCHAR AS started_at, CASE WHEN bool_or(o_orderkey % 10 = 0) THEN 'session' ELSE 'trace' END AS identity_kind, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'F') AS producer, count(*) AS deliveries FROM orders GROUP BY o_custkey",
    "unit_vectors": f"WITH {_UNIT} SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm, round(v[1], 6) AS first FROM n",
    "cosine_pairs": f"WITH {_UNIT} SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(least(1, greatest(-1, list_dot_product(a.v, b.v))), 6) AS score FROM n a JOIN n b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.4",
    "json_leaves": "SELECT event_id, '/' || e.key AS pointer, CASE WHEN e.type IN ('UBIGINT', 'BIGINT') THEN 'bigint' ELSE lower(e.type) END AS type, e.value::VARCHAR AS value FROM events, json_each(props) e",
    "otlp_flatten": f"WITH {TRACE_EVENTS} SELECT session_id, id, start_us * 1000 AS start_ns, kind, source FROM trace_events",
    "label_import": "WITH l AS (SELECT doc_id, quality, toxic FROM labels JOIN documents USING (doc_id)) SELECT doc_id, 'm1' AS model, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS category, true AS valid FROM l UNION ALL SELECT doc_id, 'm2', CASE WHEN toxic = 1 THEN 'odd' ELSE 'good' END, toxic IS DISTINCT FROM 1 FROM l",
    "stream_daily_counts": "SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
