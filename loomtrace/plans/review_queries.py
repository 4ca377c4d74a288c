"""Queries of privacy, curation, splits, captures and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import privacy as P
from loomtrace.operators.graph import dealt_anew
from loomtrace.operators import similarity as S
from loomtrace.operators import splits
from loomtrace.sources.storage import table
from loomtrace.sources.views import TRACE_EVENTS, trace_events, turns


def _spans(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"@|\d{4}|[A-Za-z0-9]\.[A-Za-z0-9]"))
    return d.withColumn("spans", P.outermost(P.findings(F.col("text"))))


def privacy_spans(spark, sf_dir):
    s = _spans(spark, sf_dir).select("doc_id", "text", F.explode("spans").alias("s"))
    return s.select("doc_id", "s.start", "s.end", "s.category", F.substr("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("quote"))


def privacy_redacted(spark, sf_dir):
    return _spans(spark, sf_dir).select("doc_id", F.size("spans").alias("n_spans"), P.replaced(F.col("text"), F.col("spans")).alias("text"))


def curation_state(spark, sf_dir):
    """Events as decisions on (session, k): the last one's state, the revision, and whether it was ever reopened."""
    e = trace_events(spark, sf_dir).withColumn("target", F.get_json_object("attributes", "$.k").cast("int"))
    state = F.when(F.col("kind") == "purchase", "verified").when(F.col("kind") == "error", "removed").otherwise("pending")
    rows = e.select("session_id", "target", state.alias("state"), "kind", F.struct("start_us", "id").alias("at"))
    return rows.groupBy("session_id", "target").agg(F.max_by("state", "at").alias("state"), F.count("*").alias("revision"), F.bool_or(F.col("kind") == "view").alias("reopened"))


def _split():
    """A session's split by a hash of its id: 70, 15 and 15 of 100."""
    h = F.conv(F.substring(F.md5(F.col("session_id").cast("string")), 1, 8), 16, 10).cast("long") % 100
    return F.when(h < 70, "train").when(h < 85, "validation").otherwise("test")


def split_support(spark, sf_dir):
    """Turns of each role in each split, zero where none, with the share of the role."""
    return splits.support(turns(spark, sf_dir).withColumn("split", _split()), "role")


def leakage_check(spark, sf_dir):
    """Texts of documents that stand in more than one split."""
    t = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "session_id").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), _split().alias("split"))
    return t.groupBy("sha256").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def capture_attempts(spark, sf_dir):
    """Each delivery with the payload that holds its bytes."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    payloads = d.groupBy("sha256").agg(F.min("doc_id").alias("payload_id"))
    return d.join(dealt_anew(payloads, "sha256"), "sha256").select("doc_id", "payload_id", (F.col("doc_id") == F.col("payload_id")).alias("stored"))


def preferred_source(spark, sf_dir):
    """Each session's events from its best source only: s2 before s0 before any other."""
    e = trace_events(spark, sf_dir)
    rank = F.struct(F.when(F.col("source") == "s2", 0).when(F.col("source") == "s0", 1).otherwise(2), F.col("source"))
    best = e.groupBy("session_id").agg(F.min_by("source", rank).alias("source"))
    return e.join(dealt_anew(best, "session_id"), ["session_id", "source"], "left_semi").groupBy("session_id", "source").agg(F.count("*").alias("n"))


def message_selection(spark, sf_dir):
    """User and assistant messages with text, redaction marks left out."""
    t = turns(spark, sf_dir).where(F.col("role").isin("user", "assistant") & (F.expr("trim(BOTH ' \\t\\n\\r' FROM text)") != ""))
    return t.where(~F.upper(F.trim("text")).isin("[REDACTED]", "REDACTED")).groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def pooled_vectors(spark, sf_dir):
    """Weighted mean of each label's vectors, the weight 1 to 3 by id: one sum a dimension."""
    v = table(spark, sf_dir, "embeddings").select("label", (1 + F.col("vec_id") % 3).alias("w"), F.posexplode("embedding").alias("pos", "x"))
    return v.groupBy("label", "pos").agg(F.round(F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w"), 5).alias("mean"))


def pair_queue(spark, sf_dir):
    """Near vectors of which both sides are active (their label is known and not 0), each pair once, with both labels."""
    v = table(spark, sf_dir, "embeddings").where("label != 0")
    rows = v.select(F.col("vec_id").alias("id"), S.unit("embedding").alias("vector"), "label")
    return S.cosine_pairs(rows, 0.35, carried=("label",)).select("left_id", "right_id", "left_label", "right_label")


def majority_baseline(spark, sf_dir):
    """The commonest kind of each session, ties to the first in the alphabet, and how often it is right."""
    n = trace_events(spark, sf_dir).groupBy("session_id", "kind").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "kind"))
    return n.groupBy("session_id").agg(best["kind"].alias("majority"), (-best["m"]).alias("hits"), F.sum("n").alias("n"))


def attribute_precedence(spark, sf_dir):
    """Attributes of a user, a type and an event merged, the narrower level winning."""
    e = trace_events(spark, sf_dir)
    levels = [F.create_map(F.lit("level"), F.lit("resource"), F.lit("user"), F.col("session_id").cast("string")), F.create_map(F.lit("level"), F.lit("scope"), F.lit("kind"), F.col("kind")), F.create_map(F.lit("k"), F.get_json_object("attributes", "$.k"))]
    keys = F.array_distinct(F.concat(*[F.map_keys(m) for m in levels]))
    merged = F.transform(F.array_sort(keys), lambda k: F.concat(k, F.lit("="), F.coalesce(*[F.try_element_at(m, k) for m in reversed(levels)])))
    return e.select("id", F.array_join(merged, ";").alias("attributes"))


def bootstrap_interval(spark, sf_dir):
    """A 95 % interval of the length rule's macro F1: 1,000 resamples of whole sources, the 25th and 975th."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("quality IN (0, 1)")
    said = F.col("n_chars") >= 500
    by = d.groupBy(F.col("source").alias("group_id")).agg(F.count_if(said & (F.col("quality") == 1)).alias("tp"), F.count_if(said & (F.col("quality") == 0)).alias("fp"), F.count_if(~said & (F.col("quality") == 1)).alias("fn"), F.count_if(~said & (F.col("quality") == 0)).alias("tn"))
    total = lambda c: F.sum(F.col(c) * F.col("times"))
    f1 = lambda hits: F.coalesce(F.try_divide(2 * total(hits), 2 * total(hits) + total("fp") + total("fn")), F.lit(0.0))
    values = splits.bootstrap(by, (f1("tp") + f1("tn")) / 2).agg(F.sort_array(F.collect_list("value")).alias("v"))  # a thousand numbers
    return values.select(F.round(F.get("v", F.lit(24)), 6).alias("low"), F.round(F.get("v", F.lit(974)), 6).alias("high"), F.size("v").alias("replicates"))


def tfidf_stages():
    """TF-IDF of words and pairs, then logistic regression; columns text, label."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer

    terms = [RegexTokenizer(inputCol="text", outputCol="words", pattern="\\s+"), NGram(n=2, inputCol="words", outputCol="pairs"), SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__")]
    return [*terms, HashingTF(inputCol="terms", outputCol="tf", numFeatures=1 << 20), IDF(inputCol="tf", outputCol="features"), LogisticRegression(maxIter=10, regParam=0.01)]


def tfidf_logistic(spark, sf_dir):
    """Quality by TF-IDF of words and pairs and logistic regression, trained on ids not divisible by 5; agreement on the others."""
    from pyspark.ml import Pipeline

    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("quality").cast("double").alias("label"))
    model = Pipeline(stages=tfidf_stages()).fit(d.where("doc_id % 5 != 0"))
    return model.transform(d.where("doc_id % 5 = 0")).groupBy("label", "prediction").agg(F.count("*").alias("n"))


def file_inventory(spark, sf_dir):
    """Every file of the documents table with its length and SHA-256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{sf_dir}/documents.parquet")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


QUERIES = {f.__name__: f for f in (privacy_spans, privacy_redacted, curation_state, split_support, leakage_check, capture_attempts, preferred_source, message_selection, pooled_vectors, pair_queue, majority_baseline, attribute_precedence, bootstrap_interval, tfidf_logistic, file_inventory)}

_TURNS = "turns AS (SELECT conv_id AS session_id, turn AS index, role, text FROM conversations)"
_SPLIT = "CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'validation' ELSE 'test' END"
_HASHED = f"{_TURNS}, hashed AS (SELECT *, ('0x' || substr(md5(session_id::VARCHAR), 1, 8))::BIGINT % 100 AS h FROM turns)"

SQL = {
    "curation_state": f"WITH {TRACE_EVENTS} SELECT session_id, json_extract_string(attributes, '$.k')::INT AS target, arg_max(CASE WHEN kind = 'purchase' THEN 'verified' WHEN kind = 'error' THEN 'removed' ELSE 'pending' END, (start_us, id)) AS state, count(*) AS revision, bool_or(kind = 'view') AS reopened FROM trace_events GROUP BY ALL",
    "split_support": f"WITH {_HASHED}, s AS (SELECT role, {_SPLIT} AS split FROM hashed), t AS (SELECT role, count(*) AS total FROM s GROUP BY role), e AS (SELECT role, split, total FROM t, (VALUES ('train'), ('validation'), ('test')) v(split)), n AS (SELECT role, split, count(*) AS n FROM s GROUP BY ALL) SELECT e.split, e.role, coalesce(n, 0) AS n, round(coalesce(n, 0) / total::DOUBLE, 6) AS share, n IS NULL AS unsupported FROM e LEFT JOIN n ON n.role = e.role AND n.split = e.split",
    "leakage_check": f"WITH hashed AS (SELECT text, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100 AS h FROM documents) SELECT sha256(coalesce(text, '')) AS sha256, count(DISTINCT {_SPLIT}) AS splits FROM hashed GROUP BY 1 HAVING count(DISTINCT {_SPLIT}) > 1",
    "capture_attempts": "WITH p AS (SELECT text, min(doc_id) AS payload_id FROM documents GROUP BY text) SELECT doc_id, payload_id, doc_id = payload_id AS stored FROM documents JOIN p USING (text)",
    "preferred_source": f"WITH {TRACE_EVENTS}, b AS (SELECT session_id, arg_min(source, (CASE WHEN source = 's2' THEN 0 WHEN source = 's0' THEN 1 ELSE 2 END, source)) AS source FROM trace_events GROUP BY 1) SELECT session_id, source, count(*) AS n FROM trace_events JOIN b USING (session_id, source) GROUP BY ALL",
    "message_selection": f"WITH {_TURNS} SELECT session_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM turns WHERE role IN ('user', 'assistant') AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND upper(trim(text)) NOT IN ('[REDACTED]', 'REDACTED') GROUP BY session_id",
    "pooled_vectors": "WITH v AS (SELECT label, 1 + vec_id % 3 AS w, i::INT AS pos, embedding[i + 1]::DOUBLE AS x FROM embeddings, unnest(range(0, 64)) u(i)) SELECT label, pos, round(sum(x * w) / sum(w), 5) AS mean FROM v GROUP BY ALL",
    "pair_queue": "WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label <> 0), n AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM u) SELECT a.vec_id AS left_id, b.vec_id AS right_id, a.label AS left_label, b.label AS right_label FROM n a JOIN n b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.35",
    "majority_baseline": f"WITH {TRACE_EVENTS}, n AS (SELECT session_id, kind, count(*) AS n FROM trace_events GROUP BY ALL) SELECT session_id, arg_min(kind, (-n, kind)) AS majority, max(n) AS hits, sum(n)::BIGINT AS n FROM n GROUP BY session_id",
    "attribute_precedence": f"WITH {TRACE_EVENTS} SELECT id, 'k=' || json_extract_string(attributes, '$.k') || ';kind=' || kind || ';level=scope;user=' || session_id AS attributes FROM trace_events",
    "bootstrap_interval": """WITH g AS (SELECT source, count(*) FILTER (n_chars >= 500 AND quality = 1) AS tp, count(*) FILTER (n_chars >= 500 AND quality = 0) AS fp, count(*) FILTER (n_chars < 500 AND quality = 1) AS fn, count(*) FILTER (n_chars < 500 AND quality = 0) AS tn FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1) GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source) - 1 AS place, count(*) OVER () AS k FROM g), d AS (SELECT r, ('0x' || substr(md5(r || ':' || j), 1, 8))::BIGINT % (SELECT count(*) FROM g) AS place FROM range(1000) a(r), range((SELECT count(*) FROM g)) b(j)),
t AS (SELECT r, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM d JOIN p USING (place) GROUP BY r),
v AS (SELECT (CASE WHEN tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END + CASE WHEN tn + fp + fn > 0 THEN 2.0::DOUBLE * tn / (2 * tn + fp + fn) ELSE 0 END) / 2 AS v FROM t), l AS (SELECT list_sort(list(v)) AS v FROM v) SELECT round(v[25], 6) AS low, round(v[975], 6) AS high, len(v)::INT AS replicates FROM l""",
}
