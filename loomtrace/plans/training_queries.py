"""Queries of replays, contexts, surrogate names, predictions and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import review as R
from loomtrace.operators.batches import microbatches as batched
from loomtrace.plans import session_queries as U
from loomtrace.sources.storage import table
from loomtrace.sources.views import TRACE_EVENTS, trace_events, turns


def attempt_replay(spark, sf_dir):
    """Orders as requests, their lines as saved attempts; those returned failed."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber > 2")
    said = li.select(F.col("l_orderkey").alias("request"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("attempt"), (F.col("l_returnflag") != "R").alias("ok"), F.col("l_partkey").alias("answer"))
    return R.replayed(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request")), said)


def artifact_listing(spark, sf_dir):
    """Suppliers, parts and nations as artifacts of three kinds, some of them not sound."""
    json = lambda key, revision: F.concat(F.lit('{"id":"'), key.cast("string"), F.lit('","revision":'), revision.cast("string"), F.lit("}"))
    s, p, n = (table(spark, sf_dir, t) for t in ("supplier", "part", "nation"))
    sup = s.select(F.col("s_suppkey").alias("id"), json(F.col("s_suppkey"), F.col("s_nationkey")).alias("document"))
    par = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 7 == 0, "{not json").otherwise(json(F.col("p_partkey"), F.col("p_size"))).alias("document"))
    nat = n.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") == 0, "{}").otherwise(json(F.col("n_nationkey") + F.when(F.col("n_regionkey") == 1, 1).otherwise(0), F.col("n_regionkey"))).alias("document"))
    return R.listed({"dataset": sup, "run": par, "staging": nat})


def branch_contexts(spark, sf_dir):
    """What a branch from a user's latest purchase of each source starts with, in at most 200 characters; views are results of the click before."""
    e = trace_events(spark, sf_dir).withColumn("k", F.get_json_object("attributes", "$.k").cast("int"))
    e = e.select("session_id", "source", F.col("id").alias("sequence"), "id", F.when(F.col("kind") == "click", "call").when(F.col("kind") == "view", "result").otherwise(F.col("kind")).alias("kind"), (F.col("k") % 10).alias("call_id"), F.concat("kind", F.lit(" "), "attributes").alias("text"))
    at = e.where("kind = 'purchase' AND source = 's1'").groupBy("session_id", "source").agg(F.max("sequence").alias("at"))
    return R.branch_context(e, at, 200)


def surrogate_ids(spark, sf_dir):
    """Messages by distinct text, numbered in order of first use over all conversations."""
    t = turns(spark, sf_dir).select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"), "session_id", "index")
    return R.surrogates(t, "text_hash", [F.col("session_id"), F.col("index")], "m", "message_id")


EMAIL = r"[A-Za-z0-9._]+@[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)+"


def pseudonym_categories(spark, sf_dir):
    """Replacements of addresses and of hosts in each source's texts, none of them a string that a text has."""
    d = table(spark, sf_dir, "documents")
    mail = d.where(F.col("text").rlike(EMAIL)).select(F.col("source").alias("group_id"), "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))).alias("place", "quote"))
    both = mail.withColumn("category", F.lit("email")).unionByName(mail.withColumns({"quote": F.substring_index("quote", "@", -1), "category": F.lit("host")}))
    return R.pseudonyms(both, d.select("text"))


def input_origins(spark, sf_dir):
    """Whose each turn is, under metadata that calls some sessions internal and some a subagent's."""
    t = turns(spark, sf_dir)
    s = F.col("session_id")
    metadata = F.when(s % 5 == 0, '{"source":"internal"}').when(s % 5 == 1, '{"source":{"subagent":"review"}}').when(s % 5 == 2, '{"source":{"other":1}}').when(s % 5 == 3, "{}").otherwise("broken")
    return t.withColumn("metadata", metadata).groupBy("session_id", R.input_origin("role", "text", "metadata").alias("origin")).agg(F.count("*").alias("n"))


def canonical_digests(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", R.canonical_digest(F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"), F.lit("name"), F.col("p_name"))).alias("sha256"))


CLASSES = ["a", "b", "c"]


def prediction_rows(spark, sf_dir):
    """Three dimensions as probabilities: scaled to add up to one, some left as they are, some short of a class."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: F.abs(x.cast("double"))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    p = F.when(F.col("vec_id") % 7 == 0, F.slice("e", 1, 2)).when(F.col("vec_id") % 7 == 1, F.col("e")).otherwise(F.transform("e", lambda x: x / total))
    return R.predicted(v.select("vec_id", p.alias("probabilities")), CLASSES).select("vec_id", "label", F.round("probability", 6).alias("probability"), "error")


def taxonomy_support(spark, sf_dir):
    """Labelled documents of every category of the taxonomy, those without any too."""
    taxonomy = spark.createDataFrame([(0, "poor"), (1, "good"), (2, "mixed"), (3, "unclear")], "category int, name string")
    n = table(spark, sf_dir, "labels").groupBy(F.col("quality").alias("category")).agg(F.count("*").alias("n"))
    return F.broadcast(taxonomy).join(n, "category", "left").select("category", "name", F.coalesce("n", F.lit(0)).alias("n"))


def usage_reports(spark, sf_dir):
    """Each session's usage as one JSON report: totals, and models in order of name with their records and exact cost."""
    rows = U._priced(spark, sf_dir)
    by = rows.groupBy("session_id", F.coalesce("model", F.lit("unknown")).alias("model")).agg(F.count("*").alias("records"), F.sum("tokens.total_tokens").alias("tokens"), F.sum("cost").cast("decimal(38,14)").cast("string").alias("usd"))
    # a session has as many models as there are at most
    report = by.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("model", "records", "tokens", "usd"))).alias("models"), F.sum("records").alias("records"), F.sum("tokens").alias("tokens"))
    return report.select("session_id", F.to_json(F.struct("records", "tokens", "models"), {"ignoreNullFields": "false"}).alias("report"))


def _inputs(spark, sf_dir):
    """Documents as inputs of a fifth as many tokens as they have characters, 4,096 at most."""
    return table(spark, sf_dir, "documents").select("doc_id", F.least(F.floor(F.col("n_chars") / 5), F.lit(4096)).cast("long").alias("tokens"))


def microbatches(spark, sf_dir):
    """Inputs in order of id, in batches of 16 at most whose longest times their number is 8,192 at most."""
    return batched(_inputs(spark, sf_dir), "tokens", [F.col("doc_id")], 16, 8192).select("doc_id", "batch", "place")


def microbatches_by_length(spark, sf_dir):
    """The same with the shortest first: batches, their rows and how much of them is padding."""
    got = batched(_inputs(spark, sf_dir), "tokens", [F.col("tokens"), F.col("doc_id")], 16, 8192)
    return got.groupBy("batch").agg(F.count("*").alias("n"), F.max("tokens").alias("longest"), (F.max("tokens") * F.count("*") - F.sum("tokens")).alias("padding"))


QUERIES = {f.__name__: f for f in (attempt_replay, artifact_listing, branch_contexts, surrogate_ids, pseudonym_categories, input_origins, canonical_digests, prediction_rows, taxonomy_support, usage_reports, microbatches, microbatches_by_length)}

_TURNS = "turns AS (SELECT conv_id AS session_id, turn AS index, role, text FROM conversations)"



def _batches(order: str) -> str:
    """Rows one by one: each either joins the batch before it or begins the next."""
    return f"""WITH RECURSIVE r AS (SELECT doc_id, least(n_chars // 5, 4096) AS tokens, row_number() OVER (ORDER BY {order}) AS i FROM documents),
b AS (SELECT i, doc_id, tokens, 0 AS batch, 0 AS place, greatest(tokens, 1) AS longest FROM r WHERE i = 1
  UNION ALL SELECT r.i, r.doc_id, r.tokens, CASE WHEN x THEN b.batch + 1 ELSE b.batch END, CASE WHEN x THEN 0 ELSE b.place + 1 END, CASE WHEN x THEN greatest(r.tokens, 1) ELSE greatest(b.longest, r.tokens, 1) END
  FROM b JOIN r ON r.i = b.i + 1, LATERAL (SELECT b.place = 15 OR greatest(b.longest, r.tokens, 1) * (b.place + 2) > 8192 AS x))"""


SQL = {
    "microbatches": _batches("doc_id") + " SELECT doc_id, batch::BIGINT AS batch, place::INT AS place FROM b",
    "microbatches_by_length": _batches("least(n_chars // 5, 4096), doc_id") + " SELECT batch::BIGINT AS batch, count(*) AS n, max(tokens) AS longest, (max(tokens) * count(*) - sum(tokens))::BIGINT AS padding FROM b GROUP BY batch",
    "attempt_replay": "WITH r AS (SELECT l_orderkey AS request, count(*) AS attempts, count(*) FILTER (l_returnflag <> 'R') AS s, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) FILTER (l_returnflag <> 'R') AS answer FROM lineitem WHERE l_linenumber > 2 GROUP BY 1) SELECT o_orderkey AS request, coalesce(attempts, 0) AS attempts, CASE WHEN attempts IS NULL THEN 'open' WHEN s > 1 THEN 'duplicate success' WHEN s = 1 THEN 'done' ELSE 'failed' END AS state, CASE WHEN s = 1 THEN answer END AS answer FROM orders LEFT JOIN r ON request = o_orderkey",
    "artifact_listing": """WITH a AS (SELECT 'dataset' AS kind, s_suppkey::VARCHAR AS id, '{"id":"' || s_suppkey || '","revision":' || s_nationkey || '}' AS d FROM supplier UNION ALL SELECT 'run', p_partkey::VARCHAR, CASE WHEN p_size % 7 = 0 THEN '{not json' ELSE '{"id":"' || p_partkey || '","revision":' || p_size || '}' END FROM part
  UNION ALL SELECT 'staging', n_nationkey::VARCHAR, CASE WHEN n_regionkey = 0 THEN '{}' ELSE '{"id":"' || (n_nationkey + CASE WHEN n_regionkey = 1 THEN 1 ELSE 0 END) || '","revision":' || n_regionkey || '}' END FROM nation),
e AS (SELECT *, CASE WHEN NOT json_valid(d) THEN 'not JSON' WHEN json_extract(d, '$.revision') IS NULL THEN 'no revision' WHEN json_extract_string(d, '$.id') IS DISTINCT FROM id THEN 'another id' END AS error FROM a) SELECT kind, id, error, CASE WHEN error IS NULL THEN json_extract_string(d, '$.revision')::BIGINT END AS revision, strlen(d)::INT AS size FROM e""",
    "branch_contexts": f"""WITH {TRACE_EVENTS}, e AS (SELECT session_id, id, CASE kind WHEN 'click' THEN 'call' WHEN 'view' THEN 'result' ELSE kind END AS kind, json_extract_string(attributes, '$.k')::INT % 10 AS c, length(kind || ' ' || attributes) AS m FROM trace_events WHERE source = 's1'),
a AS (SELECT session_id, max(id) AS upto FROM e WHERE kind = 'purchase' GROUP BY 1), b AS (SELECT e.*, min(CASE WHEN kind = 'call' THEN id END) OVER (PARTITION BY e.session_id, c) AS called FROM e JOIN a USING (session_id) WHERE id < upto),
s AS (SELECT session_id, id AS sequence, id, kind, sum(m) OVER (PARTITION BY session_id ORDER BY id DESC) AS size FROM b WHERE kind <> 'result' OR coalesce(called < id, false)) SELECT session_id, sequence, id, kind, size::BIGINT AS size FROM s WHERE size <= 200""",
    "surrogate_ids": f"WITH {_TURNS}, u AS (SELECT sha256(coalesce(text, '')) AS text_hash, min((session_id, index)) AS first FROM turns GROUP BY 1) SELECT text_hash, 'm' || lpad((row_number() OVER (ORDER BY first, text_hash) - 1)::VARCHAR, 7, '0') AS message_id FROM u",
    "pseudonym_categories": rf"""WITH d AS (SELECT source, doc_id, regexp_extract_all(text, '{EMAIL}') AS a FROM documents), q AS (SELECT source AS group_id, doc_id, i - 1 AS place, a[i] AS quote FROM d, unnest(range(1, len(a) + 1)) u(i)), b AS (SELECT *, 'email' AS category FROM q UNION ALL SELECT group_id, doc_id, place, string_split(quote, '@')[-1], 'host' FROM q),
f AS (SELECT group_id, category, quote, min((doc_id, place)) AS first FROM b GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY first, category, quote) AS n FROM f),
t AS (SELECT regexp_extract(x, '<([a-z]+)_([^<>_]+)_(\d+)>', 1) AS category, regexp_extract(x, '<([a-z]+)_([^<>_]+)_(\d+)>', 2) AS group_id, max(regexp_extract(x, '<([a-z]+)_([^<>_]+)_(\d+)>', 3)::BIGINT) AS taken FROM (SELECT unnest(regexp_extract_all(text, '<([a-z]+)_([^<>_]+)_(\d+)>')) AS x FROM documents) GROUP BY 1, 2)
SELECT n.group_id, n.category, quote, '<' || n.category || '_' || n.group_id || '_' || (n + coalesce(taken, 0)) || '>' AS replacement FROM n LEFT JOIN t ON t.category = n.category AND t.group_id = n.group_id""",
    "input_origins": rf"WITH {_TURNS} SELECT session_id, CASE WHEN role IN ('system', 'developer') THEN 'context' WHEN session_id % 5 IN (0, 1) THEN 'internal_session' WHEN regexp_matches(trim(text), '(?s)^<[a-z_]+>.*</[a-z_]+>$') AND regexp_extract(trim(text), '^<([a-z_]+)>', 1) = regexp_extract(trim(text), '</([a-z_]+)>$', 1) THEN 'notification' ELSE 'human' END AS origin, count(*) AS n FROM turns GROUP BY ALL",
    "canonical_digests": """SELECT p_partkey, sha256('{"brand":' || to_json(p_brand)::VARCHAR || ',"name":' || to_json(p_name)::VARCHAR || ',"type":' || to_json(p_type)::VARCHAR || '}' || chr(10)) AS sha256 FROM part""",
    "prediction_rows": "WITH v AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: abs(x::DOUBLE)) AS e FROM embeddings), p AS (SELECT vec_id, CASE vec_id % 7 WHEN 0 THEN e[1:2] WHEN 1 THEN e ELSE list_transform(e, lambda x: x / list_sum(e)) END AS p FROM v), s AS (SELECT *, CASE WHEN len(p) <> 3 THEN 'wrong number of classes' WHEN abs(list_sum(p) - 1) > 1e-5 THEN 'not adding up to one' END AS error FROM p) SELECT vec_id, CASE WHEN error IS NULL THEN ['a', 'b', 'c'][list_position(p, list_max(p))] END AS label, round(CASE WHEN error IS NULL THEN list_max(p) END, 6) AS probability, error FROM s",
    "taxonomy_support": "SELECT category, name, count(doc_id) AS n FROM (VALUES (0, 'poor'), (1, 'good'), (2, 'mixed'), (3, 'unclear')) t(category, name) LEFT JOIN labels ON quality = category GROUP BY ALL",
    "usage_reports": U._PRICED + """, b AS (SELECT session_id, coalesce(model, 'unknown') AS model, count(*) AS records, sum(i + o)::BIGINT AS tokens, sum(cost)::DECIMAL(38,14)::VARCHAR AS usd FROM priced GROUP BY ALL)
SELECT session_id, '{"records":' || sum(records) || ',"tokens":' || sum(tokens) || ',"models":[' || string_agg('{"model":"' || model || '","records":' || records || ',"tokens":' || tokens || ',"usd":' || coalesce('"' || usd || '"', 'null') || '}', ',' ORDER BY model) || ']}' AS report FROM b GROUP BY session_id""",
}
