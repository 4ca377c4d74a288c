"""Queries over documents by vectorized functions, and validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions import documents as D
from loomtrace.operators import merge as M
from loomtrace.sources.storage import table


def normalized_inputs(spark, sf_dir):
    """Texts that are equal once normalized: the smallest id and how many share it."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(D.normalized(F.col("text")), 256).alias("sha256"))
    return d.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def metadata_patch(spark, sf_dir):
    """Events' properties with a patch that drops k where it is even and adds a nested field."""
    e = table(spark, sf_dir, "events")
    patch = F.concat(F.lit('{"k":'), F.when(F.get_json_object("props", "$.k").cast("int") % 2 == 0, "null").otherwise(F.get_json_object("props", "$.k")), F.lit(',"meta":{"type":"'), F.col("event_type"), F.lit('"}}'))
    return e.select("event_id", D.merge_patch(F.col("props"), patch).alias("props"))


def vector_digests(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", D.vector_digest(F.col("embedding")).alias("sha256"))


def fitted_chunks(spark, sf_dir):
    """Documents in parts of at most 512 characters that join to the text again."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", D.fit_parts(F.col("text"), 512).alias("parts"))
    return d.select("doc_id", F.size("parts").alias("n_parts"), F.array_max(F.transform("parts", F.length)).alias("longest"), (F.array_join("parts", "") == F.col("text")).alias("whole"))


def tag_replacement(spark, sf_dir):
    """Each page's tags from its url's parts, cleaned."""
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(D.clean_tags(F.split("url", "[/?&]")), "|").alias("tags"))


def name_validation(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", D.valid_name(F.col("p_name")).alias("name_ok"), D.valid_name(F.col("p_brand")).alias("brand_ok"))


def softmax_argmax(spark, sf_dir):
    """Class and probability from the first eight dimensions as scores, and whether the probabilities add up to one."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", D.softmax(F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))).alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    return v.select("vec_id", D.first_best(F.col("p")).cast("int").alias("best"), F.round(F.array_max("p"), 6).alias("probability"), (F.abs(total - 1) <= 1e-5).alias("valid"))


def classification_merge(spark, sf_dir):
    """Customers as sessions, some labelled, some self-produced; results for every third."""
    c = table(spark, sf_dir, "customer")
    sessions = c.select(F.col("c_custkey").alias("session_id"), F.when(F.col("c_mktsegment") == "MACHINERY", "self").alias("producer"), F.when(F.col("c_custkey") % 4 == 0, "old").alias("label"))
    results = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("session_id"), F.lower("c_mktsegment").alias("category"), (F.col("c_custkey") % 5 == 0).alias("forced"))
    return M.write_classes(sessions, results)


def evidence_binding(spark, sf_dir):
    """Fields of orders before and after a re-read that drops one field, adds one and changes one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("owner"), "o_orderstatus")
    field = lambda name, origin: F.struct(F.lit(name).alias("field"), origin.alias("origin"))
    was = F.array(field("/a", F.lit("normalized")), field("/b", F.lit("calculated")), field("/c", F.lit("inferred")))
    now = F.array(field("/a", F.lit("normalized")), field("/b", F.when(F.col("o_orderstatus") == "F", "inferred").otherwise("calculated")), field("/d", F.lit("unknown")))
    opened = lambda fields: o.select("owner", F.inline(fields))
    return M.bind_evidence(opened(was), opened(now)).groupBy("field", "origin", "change").agg(F.count("*").alias("n"))


def rendered_commands(spark, sf_dir):
    """A prompt of each part: a quoted command line and joined content put into a template."""
    p = table(spark, sf_dir, "part")
    parts = F.array(F.struct(F.col("p_brand").alias("text")), F.struct(F.lit(None).cast("string").alias("text")), F.struct(F.col("p_type").alias("text")))
    text = D.rendered("run {command}: {content}", command=D.command_text(F.array(F.lit("find"), F.col("p_name"))), content=D.content_text(parts))
    return p.select("p_partkey", text.alias("prompt"))


QUERIES = {f.__name__: f for f in (normalized_inputs, metadata_patch, vector_digests, fitted_chunks, tag_replacement, name_validation, softmax_argmax, classification_merge, evidence_binding, rendered_commands)}

SQL = {
    "metadata_patch": """SELECT event_id, CASE WHEN json_extract_string(props, '$.k')::INT % 2 = 0 THEN '{' ELSE '{"k":' || json_extract_string(props, '$.k') || ',' END || '"meta":{"type":"' || event_type || '"}}' AS props FROM events""",
    "tag_replacement": "SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(url, '[/?&]'), lambda t: trim(t)), lambda t: t <> '' AND NOT contains(t, ',') AND length(t) <= 80))), '|') AS tags FROM pages",
    "name_validation": "SELECT p_partkey, regexp_full_match(p_name, '[A-Za-z0-9][A-Za-z0-9._-]{0,99}') AS name_ok, regexp_full_match(p_brand, '[A-Za-z0-9][A-Za-z0-9._-]{0,99}') AS brand_ok FROM part",
    "softmax_argmax": "WITH s AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS v FROM embeddings), e AS (SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM s), p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e) SELECT vec_id, (list_position(p, list_max(p)) - 1)::INT AS best, round(list_max(p), 6) AS probability, abs(list_sum(p) - 1) <= 0.00001 AS valid FROM p",
    "classification_merge": "WITH s AS (SELECT c_custkey AS session_id, c_mktsegment = 'MACHINERY' AS own, CASE WHEN c_custkey % 4 = 0 THEN 'old' END AS label, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) END AS category, c_custkey % 5 = 0 AS forced FROM customer), o AS (SELECT *, CASE WHEN category IS NULL THEN 'none' WHEN own THEN 'excluded' WHEN label IS NOT NULL AND NOT forced THEN 'labelled' ELSE 'written' END AS outcome FROM s) SELECT session_id, CASE WHEN outcome = 'written' THEN category ELSE label END AS label, outcome FROM o",
    "evidence_binding": "WITH f AS (SELECT o_orderstatus = 'F' AS changed, unnest(['/a', '/b', '/c', '/d']) AS field FROM orders) SELECT field, CASE field WHEN '/a' THEN 'normalized' WHEN '/b' THEN CASE WHEN changed THEN 'inferred' ELSE 'calculated' END WHEN '/c' THEN 'inferred' ELSE 'unknown' END AS origin, CASE field WHEN '/a' THEN 'kept' WHEN '/b' THEN CASE WHEN changed THEN 'replaced' ELSE 'kept' END WHEN '/c' THEN 'deleted' ELSE 'added' END AS change, count(*) AS n FROM f GROUP BY ALL",
}
