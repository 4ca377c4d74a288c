"""Queries of label coverage, workspaces, queues and dataset checks over documents and their labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtrace.operators import curation as C
from loomtrace.sources.storage import table
from loomtrace.sources.views import turns

CONFIGURATIONS = ["length", "quality", "toxic"]


def targets(spark, sf_dir):
    """Documents; what classifiers read is the text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("target"), F.sha2("text", 256).alias("input_hash"))


def results(spark, sf_dir):
    """Saved results of three configurations: two labels, of which some were made for another text, and a length rule that short texts break; some are of no document."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    said = l.join(d, "doc_id").select("doc_id", "quality", "toxic", F.sha2("text", 256).alias("h"), "n_chars")
    old = F.when(F.col("n_chars") % 7 == 0, "old").otherwise(F.col("h"))
    rows = said.select(F.col("doc_id").alias("target"), F.lit("quality").alias("configuration"), old.alias("input_hash"), F.col("quality").alias("category"))
    rows = rows.unionByName(said.select(F.col("doc_id").alias("target"), F.lit("toxic").alias("configuration"), F.col("h").alias("input_hash"), F.col("toxic").alias("category")))
    length = F.when(F.col("n_chars") >= 500, 1).when(F.col("n_chars") >= 100, 0).otherwise(2)
    rows = rows.unionByName(d.select(F.col("doc_id").alias("target"), F.lit("length").alias("configuration"), F.sha2("text", 256).alias("input_hash"), length.alias("category")))
    return rows.unionByName(said.where("toxic = 1").select((-1 - F.col("doc_id")).alias("target"), F.lit("toxic").alias("configuration"), F.col("h").alias("input_hash"), F.lit(1).alias("category")))


def _matrix(spark, sf_dir):
    return C.statuses(targets(spark, sf_dir), results(spark, sf_dir), CONFIGURATIONS, [0, 1])


def _workspace(spark, sf_dir):
    """Rows with the state that decisions left: long texts were verified, very long ones removed."""
    rows = C.workspace(_matrix(spark, sf_dir), "quality")
    n = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("target"), "n_chars")
    rows = rows.join(n, "target")
    return rows.withColumns({"active": F.col("n_chars") < 5000, "label": F.when(F.col("n_chars") % 11 == 0, "verified").otherwise(F.col("label"))})


def label_statuses(spark, sf_dir):
    return _matrix(spark, sf_dir)


def label_status_counts(spark, sf_dir):
    """Counts by configuration and status, and over targets: with something pending, with everything available."""
    m = _matrix(spark, sf_dir)
    by = m.groupBy("configuration").pivot("status", ["available", "changed_input", "invalid", "pending"]).count().na.fill(0)
    each = m.groupBy("target").agg(F.bool_or(F.col("status") == "pending").alias("p"), F.bool_and(F.col("status") == "available").alias("a"))
    total = each.agg(F.count("*").alias("targets"), F.count_if("p").alias("any_pending"), F.count_if("a").alias("all_available"))
    return by.crossJoin(F.broadcast(total))  # one row


def results_outside(spark, sf_dir):
    return C.outside(targets(spark, sf_dir), results(spark, sf_dir))


def workspace_rows(spark, sf_dir):
    """The matrix of results of each document, how they compare, and the reference's label."""
    shown = F.array_join(F.transform("results", lambda r: F.concat_ws("=", r["configuration"], r["status"], r["category"].cast("string"))), ";")
    return C.workspace(_matrix(spark, sf_dir), "quality").select("target", shown.alias("results"), "comparison", "complete", "category", "label")


def curation_summary(spark, sf_dir):
    """Counters over the workspace; pairs are neighbours by id of one language, decided where the first text is longer."""
    rows = _workspace(spark, sf_dir)
    d = table(spark, sf_dir, "documents")
    after = F.lead(F.struct("doc_id", "n_chars")).over(Window.partitionBy("lang", "source").orderBy("doc_id"))
    p = d.select("n_chars", after.alias("next")).where("next IS NOT NULL")
    pairs = p.select(F.when(F.col("n_chars") > F.col("next.n_chars"), "keep_both").otherwise("pending").alias("decision"), (F.col("n_chars") < 5000).alias("left_active"), (F.col("next.n_chars") < 5000).alias("right_active"))
    return C.summary(rows, pairs)


def curation_queues(spark, sf_dir):
    return _workspace(spark, sf_dir).select(F.explode(C.queues()).alias("queue"), "target")


def curation_decisions(spark, sf_dir):
    """Events as decisions of a user's workspace on pairs and turns; some saw an older revision, have no reviewer, or name what isn't there."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    action = F.element_at(F.array(*map(F.lit, C.ACTIONS)), F.pmod("k", F.lit(len(C.ACTIONS))).cast("int") + 1)
    turn, pair = F.concat(F.lit("t"), F.col("event_id") % 5), F.concat(F.lit("p"), F.col("event_id") % 4)
    log = e.select(
        F.col("user_id").alias("workspace"), F.col("event_id").alias("sequence"), (place - F.floor(place / 4)).cast("long").alias("revision"), action.alias("action"), F.when(action.isin(*C.TURN_ACTIONS), turn).otherwise(pair).alias("target"),
        F.when(F.col("k") % 3 != 0, "good").otherwise("odd").alias("category"), F.when(F.col("k") % 10 != 0, "r").otherwise(" ").alias("reviewer"), F.lit("because").alias("reason"),
    )
    users = e.select(F.col("user_id").alias("workspace")).distinct()
    rows = users.select("workspace", F.explode(F.array(*[F.lit(f"t{i}") for i in range(4)])).alias("id"))
    pairs = users.select("workspace", F.inline(F.array(*[F.struct(F.lit(f"p{i}").alias("id"), F.lit(f"t{i}").alias("left"), F.lit(f"t{i + 1}").alias("right")) for i in range(3)])))
    return C.decided(log, rows, pairs, ("good", "bad")).select("workspace", "sequence", "accepted", "why", "after", "removed", "verified")


def turn_history(spark, sf_dir):
    """Orders as history of parts and of pairs of parts: each part with the entries of its own and of its pairs."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("turn"))
    pairs = table(spark, sf_dir, "supplier").select((-F.col("s_suppkey")).alias("pair"), F.col("s_suppkey").alias("left"), (F.col("s_suppkey") + 1).alias("right"))
    li = table(spark, sf_dir, "lineitem")
    history = li.select(F.when(F.col("l_linenumber") % 2 == 0, -F.col("l_suppkey")).otherwise(F.col("l_partkey")).alias("target"), F.col("l_orderkey").alias("sequence"))
    return C.history_of(p, pairs, history).groupBy("turn").agg(F.count("*").alias("n"), F.max("sequence").alias("last"))


def reference_staleness(spark, sf_dir):
    """Labels as references made when a text had another hash, or twice: which may be used."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("id"), F.sha2(F.concat_ws("|", "lang", "text"), 256).alias("input_hash"), F.sha2("text", 256).alias("text_hash"))
    l = table(spark, sf_dir, "labels").join(d, "doc_id")
    made = l.select(F.col("doc_id").alias("id"), F.sha2(F.concat_ws("|", F.when(F.col("n_chars") % 13 == 0, "xx").otherwise(F.col("lang")), "text"), 256).alias("input_hash"), F.sha2(F.when(F.col("n_chars") % 17 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("text_hash"), F.col("quality").alias("label"))
    again = made.where("label = 0")
    return C.staleness(rows, made.unionByName(again))


def dataset_match(spark, sf_dir):
    """Documents against the same ones less those of one language and with another source for one: what only one side has."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    other = d.where("NOT lang <=> 'es'").withColumn("source", F.when(F.col("source") == "src3", "src4").otherwise(F.col("source")))
    return C.same_rows(d, other).groupBy("side").agg(F.sum("n").alias("n"))


LISTED = [907, 3, 55, 12, 3, 41]


def listed_targets(spark, sf_dir):
    """Turns of listed conversations in the order of the list, the first four of it, each with all of its context before."""
    t = turns(spark, sf_dir)
    context = t.groupBy("session_id").agg(F.count("*").alias("turns"), F.min("index").alias("first"))
    return C.in_listed_order(context, "session_id", LISTED, 4).select("place", "session_id", "turns", "first")


def target_status(spark, sf_dir):
    """empty_target, no_user_input or needs_review of each conversation."""
    t = turns(spark, sf_dir).groupBy("session_id").agg(F.bool_or(F.trim("text") != "").alias("said"), F.bool_or((F.col("role") == "user") & (F.trim("text") != "")).alias("asked"))
    return t.select("session_id", F.when(~F.coalesce("said", F.lit(False)), "empty_target").when(~F.coalesce("asked", F.lit(False)), "no_user_input").otherwise("needs_review").alias("status"))


def privacy_plan_counts(spark, sf_dir):
    """What a privacy run would read: conversations by status, messages, characters and chunks of 1,000 with an overlap of 100."""
    t = turns(spark, sf_dir).where("trim(text) != ''").groupBy("session_id").agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"), F.sum(F.greatest(F.lit(1), F.ceil((F.length("text") - 100) / 900.0))).alias("chunks"))
    j = target_status(spark, sf_dir).join(t, "session_id", "left")
    return j.groupBy("status").agg(F.count("*").alias("targets"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("messages", "chars", "chunks")))


def classification_candidates(spark, sf_dir):
    """Customers as sessions to classify: real, not the tool's own, without a label; newest first, none limited."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("latest"), F.bool_or(F.col("o_orderstatus") == "P").alias("labelled")), "c_custkey")
    rows = c.where("c_nationkey != 0 AND NOT c_mktsegment <=> 'MACHINERY' AND NOT labelled")
    return rows.select(F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("latest"), "c_custkey")).alias("rank"), "c_nationkey", "c_custkey", "latest")


def row_preview(spark, sf_dir):
    """The first 240 characters of a conversation's user messages, in order."""
    t = turns(spark, sf_dir).where("role = 'user' AND trim(text) != ''")
    # messages of which the space before them is within the 240 characters, so a long conversation isn't gathered
    before = Window.partitionBy("session_id").orderBy("index", "text").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("before", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))).where("before <= 240")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", F.substring("text", 1, 240).alias("text")))), lambda x: x["text"]), " ")
    return t.groupBy("session_id").agg(F.substring(joined, 1, 240).alias("preview"))


def classification_inputs(spark, sf_dir):
    """Hashes of what a classifier is given: prompt, schema and a transcript of at most 2,000 characters, and of all three as JSON."""
    from loomtrace.operators.turns import within_budget

    t = within_budget(turns(spark, sf_dir), 2000)
    kept = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "kept"))), lambda x: x["kept"]), "")
    rows = t.groupBy("session_id").agg(kept.alias("transcript"))  # within the budget
    parts = {"prompt": F.lit("Name the purpose."), "schema": F.lit('{"type":"object"}'), "transcript": F.col("transcript")}
    rows = rows.select("session_id", *(F.sha2(v, 256).alias(k) for k, v in parts.items()))
    return rows.withColumn("input_sha256", F.sha2(F.to_json(F.struct("prompt", "schema", "transcript")), 256))


QUERIES = {f.__name__: f for f in (label_statuses, label_status_counts, results_outside, workspace_rows, curation_summary, curation_queues, curation_decisions, turn_history, reference_staleness, dataset_match, listed_targets, target_status, privacy_plan_counts, classification_candidates, row_preview, classification_inputs)}

_TURNS = "turns AS (SELECT conv_id AS session_id, turn AS index, role, text FROM conversations)"
_RESULTS = """targets AS (SELECT doc_id AS target, sha256(text) AS h FROM documents), said AS (SELECT doc_id, quality, toxic, sha256(text) AS h, n_chars FROM labels JOIN documents USING (doc_id)),
results AS (SELECT doc_id AS target, 'quality' AS configuration, CASE WHEN n_chars % 7 = 0 THEN 'old' ELSE h END AS saved, quality AS category FROM said UNION ALL SELECT doc_id, 'toxic', h, toxic FROM said
  UNION ALL SELECT doc_id, 'length', sha256(text), CASE WHEN n_chars >= 500 THEN 1 WHEN n_chars >= 100 THEN 0 ELSE 2 END FROM documents UNION ALL SELECT -1 - doc_id, 'toxic', h, 1 FROM said WHERE toxic = 1),
matrix AS (SELECT t.target, c.configuration, CASE WHEN r.target IS NULL THEN 'pending' WHEN r.saved IS DISTINCT FROM t.h THEN 'changed_input' WHEN coalesce(r.category NOT IN (0, 1), true) THEN 'invalid' ELSE 'available' END AS status, r.category
  FROM targets t CROSS JOIN (VALUES ('length'), ('quality'), ('toxic')) c(configuration) LEFT JOIN results r ON r.target = t.target AND r.configuration = c.configuration),
workspace AS (SELECT target, string_agg(concat_ws('=', configuration, status, category::VARCHAR), ';' ORDER BY configuration) AS results, CASE WHEN count(*) FILTER (status = 'available') < 2 THEN 'insufficient' WHEN count(DISTINCT category) FILTER (status = 'available') > 1 THEN 'disagreement' ELSE 'agreement' END AS comparison,
  count(*) FILTER (status = 'available') = count(*) AS complete, max(category) FILTER (status = 'available' AND configuration = 'quality') AS category FROM matrix GROUP BY target),
rows AS (SELECT w.*, CASE WHEN n_chars % 11 = 0 THEN 'verified' WHEN category IS NULL THEN 'unlabeled' ELSE 'inferred' END AS label, n_chars < 5000 AS active FROM workspace w JOIN documents ON doc_id = target)"""
_STATUS = f"{_TURNS}, status AS (SELECT session_id, CASE WHEN NOT coalesce(bool_or(trim(text) <> ''), false) THEN 'empty_target' WHEN NOT coalesce(bool_or(role = 'user' AND trim(text) <> ''), false) THEN 'no_user_input' ELSE 'needs_review' END AS status FROM turns GROUP BY session_id)"

#: A workspace's state as lists, one decision a round.
_DECISIONS = """WITH RECURSIVE log AS (SELECT user_id AS workspace, event_id AS sequence, (props->>'$.k')::INT AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
l AS (SELECT *, (i - 1) - (i - 1) // 4 AS revision, ['verify', 'reopen_label', 'restore', 'keep_both', 'remove_left', 'remove_right', 'reopen_pair'][k % 7 + 1] AS action, CASE WHEN k % 7 < 3 THEN 't' || (sequence % 5) ELSE 'p' || (sequence % 4) END AS target,
    CASE WHEN k % 7 >= 3 AND sequence % 4 < 3 THEN 't' || (sequence % 4) END AS l, CASE WHEN k % 7 >= 3 AND sequence % 4 < 3 THEN 't' || (sequence % 4 + 1) END AS r FROM log),
f AS (SELECT DISTINCT workspace, 0::BIGINT AS i, 0::BIGINT AS after, []::STRUCT(gone VARCHAR, kept VARCHAR)[] AS removed, []::VARCHAR[] AS verified, NULL::BIGINT AS sequence, NULL::VARCHAR AS why FROM l
  UNION ALL SELECT f.workspace, l.i, f.after + CASE WHEN w IS NULL THEN 1 ELSE 0 END,
    CASE WHEN w IS NOT NULL THEN f.removed WHEN action = 'restore' THEN list_filter(f.removed, lambda x: x.gone <> target) WHEN action = 'remove_left' THEN list_append(f.removed, {'gone': l.l, 'kept': l.r}) WHEN action = 'remove_right' THEN list_append(f.removed, {'gone': l.r, 'kept': l.l}) ELSE f.removed END,
    CASE WHEN w IS NOT NULL THEN f.verified WHEN action = 'verify' THEN list_distinct(list_append(f.verified, target)) WHEN action = 'reopen_label' THEN list_filter(f.verified, lambda x: x <> target) ELSE f.verified END, l.sequence, w
  FROM f JOIN l ON l.workspace = f.workspace AND l.i = f.i + 1, LATERAL (SELECT CASE WHEN l.revision <> f.after THEN 'stale revision' WHEN k % 10 = 0 THEN 'no reviewer or reason'
    WHEN (k % 7 < 3 AND target = 't4') OR (k % 7 >= 3 AND l.l IS NULL) THEN 'unknown target' WHEN action = 'verify' AND k % 3 = 0 THEN 'unknown category'
    WHEN k % 7 >= 3 AND len(list_filter(f.removed, lambda x: x.gone IN (l.l, l.r))) > 0 THEN 'pair is not active'
    WHEN action = 'remove_left' AND len(list_filter(f.removed, lambda x: x.kept = l.l)) > 0 THEN 'others were removed for it' WHEN action = 'remove_right' AND len(list_filter(f.removed, lambda x: x.kept = l.r)) > 0 THEN 'others were removed for it' END AS w))"""

SQL = {
    "curation_decisions": _DECISIONS + " SELECT workspace, sequence, why IS NULL AS accepted, why, after, len(removed) AS removed, len(verified) AS verified FROM f WHERE i > 0",
    "label_statuses": f"WITH {_RESULTS} SELECT * FROM matrix",
    "label_status_counts": f"WITH {_RESULTS}, e AS (SELECT target, bool_or(status = 'pending') AS p, bool_and(status = 'available') AS a FROM matrix GROUP BY target) SELECT configuration, {', '.join(f'count(*) FILTER (status = {s!r}) AS {s}' for s in ('available', 'changed_input', 'invalid', 'pending'))}, (SELECT count(*) FROM e) AS targets, (SELECT count(*) FROM e WHERE p) AS any_pending, (SELECT count(*) FROM e WHERE a) AS all_available FROM matrix GROUP BY configuration",
    "results_outside": f"WITH {_RESULTS} SELECT target, configuration FROM results WHERE target NOT IN (SELECT target FROM targets)",
    "workspace_rows": f"WITH {_RESULTS} SELECT target, results, comparison, complete, category, CASE WHEN category IS NULL THEN 'unlabeled' ELSE 'inferred' END AS label FROM workspace",
    "curation_summary": f"""WITH {_RESULTS}, p AS (SELECT n_chars, lead((doc_id, n_chars)) OVER (PARTITION BY lang, source ORDER BY doc_id) AS nx FROM documents), q AS (SELECT n_chars AS a, nx[2] AS b FROM p WHERE nx IS NOT NULL)
SELECT count(*) AS turns, count(*) FILTER (label = 'unlabeled') AS unlabeled, count(*) FILTER (label = 'inferred') AS inferred, count(*) FILTER (label = 'verified') AS verified, count(*) FILTER (NOT active) AS removed, count(*) FILTER (comparison = 'disagreement' AND label <> 'verified' AND active) AS unresolved, count(*) FILTER (NOT complete) AS incomplete,
  (SELECT count(*) FROM q) AS suggestions, (SELECT count(*) FROM q WHERE a <= b AND a < 5000 AND b < 5000) AS pending_pairs FROM rows""",
    "curation_queues": f"WITH {_RESULTS} SELECT 'all' AS queue, target FROM rows UNION ALL SELECT 'disagreements', target FROM rows WHERE active AND comparison = 'disagreement' AND label <> 'verified' UNION ALL SELECT 'unlabeled', target FROM rows WHERE active AND label = 'unlabeled' UNION ALL SELECT 'verified', target FROM rows WHERE label = 'verified' UNION ALL SELECT 'removed', target FROM rows WHERE NOT active",
    "turn_history": "WITH h AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN -l_suppkey ELSE l_partkey END AS target, l_orderkey AS sequence FROM lineitem), o AS (SELECT p_partkey AS turn, p_partkey AS target FROM part UNION SELECT p_partkey, -s_suppkey FROM part JOIN supplier ON p_partkey = s_suppkey OR p_partkey = s_suppkey + 1) SELECT turn, count(*) AS n, max(sequence) AS last FROM o JOIN h USING (target) GROUP BY turn",
    "reference_staleness": """WITH d AS (SELECT doc_id AS id, sha256(concat_ws('|', lang, text)) AS i, sha256(text) AS t FROM documents), l AS (SELECT doc_id AS id, sha256(concat_ws('|', CASE WHEN n_chars % 13 = 0 THEN 'xx' ELSE lang END, text)) AS i, sha256(CASE WHEN n_chars % 17 = 0 THEN text || '.' ELSE text END) AS t, quality AS label FROM labels JOIN documents USING (doc_id)),
a AS (SELECT * FROM l UNION ALL SELECT * FROM l WHERE label = 0), n AS (SELECT id, count(*) AS n, any_value(i) AS i, any_value(t) AS t, any_value(label) AS label FROM a GROUP BY id), s AS (SELECT d.id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN n.i IS DISTINCT FROM d.i THEN 'changed input' WHEN n.t IS DISTINCT FROM d.t THEN 'changed text' ELSE 'usable' END AS state, label FROM d LEFT JOIN n ON n.id = d.id)
SELECT id, state, CASE WHEN state = 'usable' THEN label END AS label FROM s""",
    "dataset_match": "WITH a AS (SELECT doc_id, lang, source, n_chars FROM documents), b AS (SELECT doc_id, lang, CASE WHEN source = 'src3' THEN 'src4' ELSE source END AS source, n_chars FROM documents WHERE lang IS DISTINCT FROM 'es'), x AS (SELECT 'left' AS side, count(*) AS n FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT 'right', count(*) FROM (FROM b EXCEPT ALL FROM a)) SELECT side, n FROM x WHERE n > 0",
    "listed_targets": f"WITH {_TURNS}, w(place, session_id) AS (VALUES {', '.join(f'({i}, {k})' for i, k in enumerate(LISTED[:4]))}) SELECT place, session_id, count(*) AS turns, min(index) AS first FROM turns JOIN w USING (session_id) GROUP BY ALL",
    "target_status": f"WITH {_STATUS} SELECT * FROM status",
    "privacy_plan_counts": f"WITH {_STATUS}, t AS (SELECT session_id, count(*) AS messages, sum(length(text))::BIGINT AS chars, sum(greatest(1, ceil((length(text) - 100) / 900.0)))::BIGINT AS chunks FROM turns WHERE trim(text) <> '' GROUP BY session_id) SELECT status, count(*) AS targets, coalesce(sum(messages), 0)::BIGINT AS messages, coalesce(sum(chars), 0)::BIGINT AS chars, coalesce(sum(chunks), 0)::BIGINT AS chunks FROM status LEFT JOIN t USING (session_id) GROUP BY status",
    "classification_candidates": "WITH o AS (SELECT o_custkey AS c_custkey, max(o_orderkey) AS latest, bool_or(o_orderstatus = 'P') AS labelled FROM orders GROUP BY 1) SELECT row_number() OVER (PARTITION BY c_nationkey ORDER BY latest DESC, c_custkey)::INT AS rank, c_nationkey, c_custkey, latest FROM customer JOIN o USING (c_custkey) WHERE c_nationkey <> 0 AND c_mktsegment IS DISTINCT FROM 'MACHINERY' AND NOT labelled",
    "row_preview": f"WITH {_TURNS} SELECT session_id, substr(string_agg(substr(text, 1, 240), ' ' ORDER BY index, text), 1, 240) AS preview FROM turns WHERE role = 'user' AND trim(text) <> '' GROUP BY session_id",
    "classification_inputs": f"""WITH {_TURNS}, l AS (SELECT *, role || ': ' || text || chr(10) AS line FROM turns), r AS (SELECT *, 2000 - coalesce(sum(length(line)) OVER (PARTITION BY session_id ORDER BY index, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM l),
k AS (SELECT session_id, string_agg(substr(line, 1, room::INT), '' ORDER BY index, line) AS t FROM r WHERE room > 0 GROUP BY session_id), h AS (SELECT session_id, sha256('Name the purpose.') AS prompt, sha256('{{"type":"object"}}') AS schema, sha256(t) AS transcript FROM k)
SELECT *, sha256('{{"prompt":"' || prompt || '","schema":"' || schema || '","transcript":"' || transcript || '"}}') AS input_sha256 FROM h""",
}
