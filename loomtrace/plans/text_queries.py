"""Queries over conversations, documents and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtrace.functions import text as X
from loomtrace.operators import turns as T
from loomtrace.operators.graph import components, dealt_anew, dependencies
from loomtrace.sources.storage import table
from loomtrace.sources.views import micros, turns

EMAIL = r"[A-Za-z0-9._]+@[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)+"


def keyword_purpose(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.purpose(F.coalesce("text", F.lit(""))).alias("purpose"))


def regex_extracts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    page = F.regexp_extract("url", r"[?&]page=(\d+)", 1)
    return p.select("page_id", F.when(page != "", page.cast("double") * 1000).alias("page_ms"), F.element_at(F.split("url", "\\."), -1).alias("last_part"), F.col("url").rlike(r"utm_source=\w+").alias("tracked"), F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"))


def input_attribution(spark, sf_dir):
    """context, notification or human, by precedence."""
    t = turns(spark, sf_dir)
    origin = F.when(F.col("role") == "system", "context").when(F.trim("text") == "", "blank").when(F.trim("text").rlike(r"^<[a-z_]+>[^<]*</[a-z_]+>$"), "notification").when(F.col("role") == "user", "human").otherwise("agent")
    return t.groupBy("session_id", origin.alias("origin")).agg(F.count("*").alias("n"))


def canonical_timestamps(spark, sf_dir):
    us = micros("ts")
    return table(spark, sf_dir, "events").select("event_id", X.nanos_string(us).alias("at"), (us * 1000).alias("epoch_ns"))


def stable_ids(spark, sf_dir):
    return turns(spark, sf_dir).select("session_id", "index", X.stable_id(F.col("session_id"), F.col("index"), F.col("role")).alias("id"))


def line_fingerprints(spark, sf_dir):
    """SHA-256 of each line without its line end; physical lines count from 1, blank ones too."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.select("doc_id", (F.col("pos") + 1).alias("line_number"), F.sha2(F.regexp_replace("line", "\r+$", ""), 256).alias("sha256"))


def chunk_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.chunks(F.col("text"), 1000, 100)).alias("c"))
    return d.select("doc_id", "c.start", F.length("c.chunk").alias("size"), F.sha2("c.chunk", 256).alias("sha256"))


def span_replace(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(EMAIL)).select("doc_id", F.regexp_replace("text", EMAIL, "[EMAIL]").alias("text"))


def pseudonym_numbers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike(EMAIL))
    quotes = d.select(F.col("source").alias("group_id"), "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))).alias("place", "quote"))
    return T.pseudonyms(quotes)


def transcript_budget(spark, sf_dir):
    return T.within_budget(turns(spark, sf_dir), 2000)


def first_prompt_title(spark, sf_dir):
    t = turns(spark, sf_dir).where("role = 'user' AND trim(text) != ''")
    return t.groupBy("session_id").agg(X.title(F.min(F.struct("index", "text"))["text"]).alias("title"))


def turn_serialization(spark, sf_dir):
    """Each assistant turn with the user turn before it, under section marks."""
    t = turns(spark, sf_dir)
    rows = T.previous(t, "text", "previous").where("role = 'assistant'")
    text = F.concat(F.lit("[TARGET TURN]\n"), "text", F.lit("\n[PRECEDING TURN CONTEXT]\n"), F.coalesce("previous", F.lit("[EMPTY]")))
    return rows.select("session_id", "index", F.sha2(text, 256).alias("sha256"), F.length(text).alias("size"))


def predecessor_join(spark, sf_dir):
    return T.previous(turns(spark, sf_dir), "role", "previous_role").select("session_id", "index", "role", "previous_role")


def previous_turn_check(spark, sf_dir):
    """Turns of users that don't follow their session's one before by one."""
    w = Window.partitionBy("session_id").orderBy("index")
    t = turns(spark, sf_dir).where("role = 'user'").select("session_id", "index").distinct().withColumn("prior", F.lag("index").over(w))
    return t.where("prior IS NOT NULL AND index != prior + 1")


def role_transitions(spark, sf_dir):
    w = Window.partitionBy("session_id").orderBy("index", "role")
    t = turns(spark, sf_dir).withColumn("next", F.lead("role").over(w))
    return t.where("next IS NOT NULL").groupBy("role", "next").agg(F.count("*").alias("n"))


def _single_turns(spark, sf_dir):
    """Documents as sessions of one turn: some say what others do."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), "text")


def _edges(texts):
    """Sessions that share a turn's text, each with the smallest of them: as many edges as sharers, whatever their number."""
    t = texts.select("session_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")).distinct()
    first = t.groupBy("sha256").agg(F.min("session_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return t.join(dealt_anew(first, "sha256"), "sha256").where("session_id != first").select(F.col("session_id").alias("u"), F.col("first").alias("v"))


def duplicate_edges(spark, sf_dir):
    return _edges(_single_turns(spark, sf_dir)).distinct()


def _texts(spark, sf_dir):
    """What sessions say: conversations by all of their turns, and documents as sessions of one turn, numbered down from -1."""
    d = table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("session_id"), "text")
    return turns(spark, sf_dir).select("session_id", "text").unionByName(d)


def connected_groups(spark, sf_dir):
    """Every session with the smallest session that shared texts connect it to, over however many others."""
    t = _texts(spark, sf_dir)
    of = components(_edges(t))
    s = t.select("session_id").distinct()
    return s.join(of, s.session_id == of.node, "left").select("session_id", F.coalesce("component", "session_id").alias("group_id"))


def chronological_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    groups = o.groupBy(F.col("o_custkey").alias("group_id")).agg(F.max(F.to_date("o_orderdate")).alias("latest"))
    return T.chronological_split(groups).select("group_id", F.col("latest").cast("string").alias("latest"), "split")


def split_time_overlap(spark, sf_dir):
    """Whether a split of the customers' orders in time begins before the one before it has ended."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group_id"), F.to_date("o_orderdate").alias("at"))
    groups = o.groupBy("group_id").agg(F.max("at").alias("latest"))
    found = T.split_overlaps(T.chronological_split(groups), o)
    return found.select("split", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), "n", "overlaps")


def endless_chains(spark, sf_dir):
    """Parts whose chain of successors never ends: each leads to the part of its size times its key, past the last none."""
    p = table(spark, sf_dir, "part")
    n = p.agg(F.max("p_partkey").alias("n"))
    to = F.col("p_partkey") + F.when(F.col("p_size") % 2 == 0, F.col("p_size")).otherwise(-F.col("p_size"))
    nodes = p.crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("id"), F.when((to >= 1) & (to <= F.col("n")), to).alias("parent"))  # one row
    return T.without_end(nodes)


def nearest_rank_percentiles(spark, sf_dir):
    return T.nearest_rank(table(spark, sf_dir, "documents"), "n_chars", [0, 50, 90, 95, 100])


def capture_dedupe(spark, sf_dir):
    """Payloads by content, each stored once, with its deliveries."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("payload_id"), F.count("*").alias("attempts"), F.max(F.octet_length("text")).alias("byte_count"))


def ancestor_identity(spark, sf_dir):
    """The nearest flagged node above each order: itself, its customer, nation or region."""
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    name = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    flag = lambda cond, p, col: F.when(cond, name(p, col))
    nodes = o.select(name("o", "o_orderkey").alias("id"), name("c", "o_custkey").alias("parent"), flag(F.col("o_totalprice") > 300000, "o", "o_orderkey").alias("identity"))
    nodes = nodes.unionByName(c.select(name("c", "c_custkey").alias("id"), name("n", "c_nationkey").alias("parent"), flag(F.col("c_acctbal") < 0, "c", "c_custkey").alias("identity")))
    nodes = nodes.unionByName(n.select(name("n", "n_nationkey").alias("id"), name("r", "n_regionkey").alias("parent"), flag(F.col("n_nationkey") % 5 == 0, "n", "n_nationkey").alias("identity")))
    nodes = nodes.unionByName(table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), name("r", "r_regionkey").alias("identity")))
    return T.nearest_identity(nodes.distinct()).where("id LIKE 'o%'")


def dependency_closure(spark, sf_dir):
    """What each supplier's row depends on: its nation and that nation's region."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    edges = s.select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.concat(F.lit("n"), "s_nationkey").alias("needs"))
    edges = edges.unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("needs")))
    return dependencies(s.select(F.concat(F.lit("s"), "s_suppkey").alias("root")), edges)


QUERIES = {f.__name__: f for f in (keyword_purpose, regex_extracts, input_attribution, canonical_timestamps, stable_ids, line_fingerprints, chunk_windows, span_replace, pseudonym_numbers, transcript_budget, first_prompt_title, turn_serialization, predecessor_join, previous_turn_check, role_transitions, duplicate_edges, connected_groups, chronological_split, split_time_overlap, endless_chains, nearest_rank_percentiles, capture_dedupe, ancestor_identity, dependency_closure)}

_TURNS = "turns AS (SELECT conv_id AS session_id, turn AS index, role, text FROM conversations)"
_SINGLE = "turns AS (SELECT doc_id AS session_id, text FROM documents)"
_BOTH = "turns AS (SELECT conv_id AS session_id, text FROM conversations UNION ALL SELECT -1 - doc_id, text FROM documents)"
_EDGES = "t AS (SELECT DISTINCT session_id, sha256(coalesce(text, '')) AS h FROM turns), f AS (SELECT h, min(session_id) AS first FROM t GROUP BY h HAVING count(*) > 1), edges AS (SELECT DISTINCT session_id AS u, first AS v FROM t JOIN f USING (h) WHERE session_id <> first)"
_CASE = " ".join(rf"WHEN regexp_matches(lower(text), '(^|[^\p{{L}}])({w})($|[^\p{{L}}])') THEN '{n}'" for n, w in X.PURPOSES)

SQL = {
    "keyword_purpose": f"SELECT doc_id, CASE {_CASE} ELSE 'other' END AS purpose FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
    "regex_extracts": r"SELECT page_id, nullif(regexp_extract(url, '[?&]page=(\d+)', 1), '')::DOUBLE * 1000 AS page_ms, string_split(url, '.')[-1] AS last_part, regexp_matches(url, 'utm_source=\w+') AS tracked, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages",
    "input_attribution": f"WITH {_TURNS} SELECT session_id, CASE WHEN role = 'system' THEN 'context' WHEN trim(text) = '' THEN 'blank' WHEN regexp_matches(trim(text), '^<[a-z_]+>[^<]*</[a-z_]+>$') THEN 'notification' WHEN role = 'user' THEN 'human' ELSE 'agent' END AS origin, count(*) AS n FROM turns GROUP BY ALL",
    "canonical_timestamps": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(((epoch_us(ts) % 1000000) * 1000)::VARCHAR, 9, '0') || 'Z' AS at, epoch_us(ts) * 1000 AS epoch_ns FROM events",
    "stable_ids": f"""WITH {_TURNS} SELECT session_id, index, substr(sha256('["' || session_id || '", "' || index || '", "' || role || '"]'), 1, 32) AS id FROM turns""",
    "line_fingerprints": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents) SELECT doc_id, i::INT AS line_number, sha256(regexp_replace(a[i], '\\r+$', '')) AS sha256 FROM l, unnest(range(1, len(a) + 1)) u(i)",
    "chunk_windows": "WITH d AS (SELECT doc_id, text, greatest(1, ceil((length(text) - 100) / 900.0))::INT AS n FROM documents WHERE trim(text) <> '') SELECT doc_id, (i * 900)::INT AS start, length(substr(text, i * 900 + 1, 1000))::INT AS size, sha256(substr(text, i * 900 + 1, 1000)) AS sha256 FROM d, unnest(range(0, n)) u(i)",
    "span_replace": f"SELECT doc_id, regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g') AS text FROM documents WHERE regexp_matches(text, '{EMAIL}')",
    "pseudonym_numbers": f"WITH d AS (SELECT source, doc_id, regexp_extract_all(text, '{EMAIL}') AS a FROM documents), q AS (SELECT source AS group_id, doc_id, i AS place, a[i] AS quote FROM d, unnest(range(1, len(a) + 1)) u(i)), f AS (SELECT group_id, quote, min((doc_id, place)) AS first, count(*) AS times FROM q GROUP BY ALL) SELECT group_id, quote, '[EMAIL_' || row_number() OVER (PARTITION BY group_id ORDER BY first) || ']' AS pseudonym, times FROM f",
    "transcript_budget": f"WITH {_TURNS}, l AS (SELECT *, role || ': ' || text || chr(10) AS line FROM turns), r AS (SELECT *, 2000 - coalesce(sum(length(line)) OVER (PARTITION BY session_id ORDER BY index, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM l) SELECT session_id, index, substr(line, 1, room::INT) AS kept, length(line) > room AS truncated FROM r WHERE room > 0",
    "first_prompt_title": f"WITH {_TURNS} SELECT session_id, substr(string_split(trim(min((index, text))[2]), chr(10))[1], 1, 100) AS title FROM turns WHERE role = 'user' AND trim(text) <> '' GROUP BY session_id",
    "turn_serialization": f"WITH {_TURNS}, s AS (SELECT a.session_id, a.index, '[TARGET TURN]' || chr(10) || a.text || chr(10) || '[PRECEDING TURN CONTEXT]' || chr(10) || coalesce(b.text, '[EMPTY]') AS t FROM turns a LEFT JOIN turns b ON b.session_id = a.session_id AND b.index = a.index - 1 WHERE a.role = 'assistant') SELECT session_id, index, sha256(t) AS sha256, length(t)::INT AS size FROM s",
    "predecessor_join": f"WITH {_TURNS} SELECT a.session_id, a.index, a.role, b.role AS previous_role FROM turns a LEFT JOIN turns b ON b.session_id = a.session_id AND b.index = a.index - 1",
    "previous_turn_check": f"WITH {_TURNS}, d AS (SELECT DISTINCT session_id, index FROM turns WHERE role = 'user'), l AS (SELECT *, lag(index) OVER (PARTITION BY session_id ORDER BY index) AS prior FROM d) SELECT * FROM l WHERE prior IS NOT NULL AND index <> prior + 1",
    "role_transitions": f"WITH {_TURNS}, l AS (SELECT role, lead(role) OVER (PARTITION BY session_id ORDER BY index, role) AS next FROM turns) SELECT role, next, count(*) AS n FROM l WHERE next IS NOT NULL GROUP BY ALL",
    "duplicate_edges": f"WITH {_SINGLE}, {_EDGES} SELECT * FROM edges",
    "connected_groups": f"WITH RECURSIVE {_BOTH}, {_EDGES}, e AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges), r AS (SELECT DISTINCT session_id AS a, session_id AS b FROM turns UNION SELECT a, v FROM r JOIN e ON u = b) SELECT a AS session_id, min(b) AS group_id FROM r GROUP BY a",
    "chronological_split": "WITH g AS (SELECT o_custkey AS group_id, max(o_orderdate::DATE) AS latest FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY latest, group_id) AS at, count(*) OVER () AS total FROM g), h AS (SELECT *, greatest(1, round_even(total * 0.15, 0)::BIGINT) AS hold FROM r) SELECT group_id, latest::VARCHAR AS latest, CASE WHEN at > total - hold THEN 'test' WHEN at > total - 2 * hold THEN 'validation' ELSE 'train' END AS split FROM h".replace(" AS at,", " AS place,").replace("WHEN at >", "WHEN place >"),
    "nearest_rank_percentiles": "WITH r AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) AS k, count(*) OVER () AS n FROM documents WHERE n_chars IS NOT NULL) SELECT p AS percent, n_chars AS value FROM r, (VALUES (0), (50), (90), (95), (100)) v(p) WHERE k = round_even((n - 1) * p / 100.0, 0)::BIGINT + 1",
    "endless_chains": "WITH RECURSIVE p AS (SELECT p_partkey AS id, p_partkey + CASE WHEN p_size % 2 = 0 THEN p_size ELSE -p_size END AS t FROM part), e AS (SELECT id, t FROM p WHERE t BETWEEN 1 AND (SELECT max(id) FROM p)), s(id) AS (SELECT id FROM p WHERE id NOT IN (SELECT id FROM e) UNION SELECT e.id FROM e JOIN s ON e.t = s.id) SELECT id FROM p WHERE id NOT IN (SELECT id FROM s)",
    "capture_dedupe": "SELECT sha256(text) AS sha256, min(doc_id) AS payload_id, count(*) AS attempts, max(strlen(text))::INT AS byte_count FROM documents GROUP BY 1",
    "ancestor_identity": "SELECT DISTINCT 'o' || o_orderkey AS id, CASE WHEN o_totalprice > 300000 THEN 'o' || o_orderkey WHEN c_acctbal < 0 THEN 'c' || c_custkey WHEN n_nationkey % 5 = 0 THEN 'n' || n_nationkey ELSE 'r' || n_regionkey END AS identity FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey",
    "dependency_closure": "WITH x AS (SELECT 's' || s_suppkey AS root, 'n' || s_nationkey AS n, 'r' || n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey) SELECT DISTINCT root, unnest([root, n, r]) AS node, unnest([0, 1, 2]) AS depth FROM x",
}
SQL["split_time_overlap"] = (
    "WITH s AS (" + SQL["chronological_split"] + "), x AS (SELECT split, min(o_orderdate::DATE) AS first, max(o_orderdate::DATE) AS last, count(*) AS n FROM orders JOIN s ON s.group_id = o_custkey GROUP BY split) "
    "SELECT split, first::VARCHAR AS first, last::VARCHAR AS last, n, coalesce(first < lag(last) OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END), false) AS overlaps FROM x"
)
