"""Queries of scan results over chunks of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions import text as X
from loomtrace.operators import scans
from loomtrace.sources.storage import table, written

SIZE, OVERLAP = 400, 100


def _chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("message"), F.inline(X.chunks(F.coalesce("text", F.lit("")), SIZE, OVERLAP)))
    return d.select("message", F.concat_ws(":", "message", "start").alias("chunk_id"), "start", F.col("chunk").alias("text"))


def _results(chunks):
    """What a scanner says of each chunk: the first "the" and the first "en" in it. Of every fourth message some results break a rule, of every seventh one is missing."""
    c, k = F.col, F.pmod(F.col("start") / (SIZE - OVERLAP), F.lit(11)).cast("int")
    broken = F.when(c("message") % 4 == 0, k).otherwise(99)

    def finding(quote: str, category: str):
        at = F.instr("text", quote) - 1
        b = at + len(quote) + F.when(broken == 4, 500).otherwise(0)
        last = F.when(broken == 3, "").otherwise(F.concat(F.lit(', "category": "'), F.when(broken == 6, "odd").otherwise(category), F.lit('"')))
        json = F.concat(F.lit('{"start": '), at.cast("string"), F.lit(', "end": '), b.cast("string"), F.lit(', "quote": "'), F.when(broken == 5, "zz").otherwise(quote), F.lit('"'), last, F.lit("}"))
        return F.when(at >= 0, json)

    found = F.concat(F.lit("["), F.concat_ws(", ", finding("the", "name"), finding("en", "place")), F.lit("]"))
    body = F.concat(
        F.lit('{"chunk_id": "'), c("chunk_id"), F.when(broken == 1, "x").otherwise(""), F.lit('", "requires_review": '), F.when(broken == 7, '"no"').when(c("message") % 5 == 0, "true").otherwise("false"),
        F.lit(', "findings": '), F.when(broken == 2, '"none"').otherwise(found), F.when(broken == 0, ', "more": 1').otherwise(""), F.lit("}"),
    )
    return chunks.where(~((c("message") % 7 == 0) & (c("start") == SIZE - OVERLAP))).select("chunk_id", body.alias("body"))


def scan_results(spark, sf_dir):
    """Each chunk's result: sound, or the first rule that it breaks."""
    chunks = _chunks(spark, sf_dir)
    return scans.validated(_results(chunks), chunks, ("name", "place")).select("message", "chunk_id", "reason", F.size("findings").alias("n"))


def scan_messages(spark, sf_dir):
    """Messages whose results all hold and agree, with their findings, or why they are refused."""
    chunks = _chunks(spark, sf_dir)
    # read four times, and each would check all results again
    checked = written(scans.validated(_results(chunks), chunks, ("name", "place")), "checked")
    messages, found = scans.merged(checked, chunks)
    n = found.groupBy("message").agg(F.count("*").alias("n"), F.sum("start").alias("places"))
    return messages.join(n, "message", "left").select("message", "state", "reason", "review", "n", "places")


QUERIES = {f.__name__: f for f in (scan_results, scan_messages)}

_CHECKED = f"""WITH d AS (SELECT doc_id AS message, coalesce(text, '') AS t FROM documents WHERE trim(coalesce(text, ''), ' ') <> ''),
c AS (SELECT message, i * {SIZE - OVERLAP} AS start, substr(t, i * {SIZE - OVERLAP} + 1, {SIZE}) AS text FROM (SELECT *, unnest(range(greatest(1, ceil((length(t) - {OVERLAP}) / {SIZE - OVERLAP}.0)::INT))) AS i FROM d)),
r AS (SELECT *, CASE WHEN message % 4 = 0 THEN (start // {SIZE - OVERLAP}) % 11 ELSE 99 END AS k, strpos(text, 'the') - 1 AS a, strpos(text, 'en') - 1 AS b FROM c WHERE NOT (message % 7 = 0 AND start = {SIZE - OVERLAP})),
v AS (SELECT *, a >= 0 OR b >= 0 AS any_found, CASE WHEN k = 0 THEN 'unexpected result fields' WHEN k IN (1, 7) THEN 'another chunk or no review flag' WHEN k = 2 THEN 'findings are no list' WHEN a < 0 AND b < 0 THEN NULL WHEN k = 3 THEN 'unexpected finding fields'
  WHEN k = 4 THEN 'bounds outside the chunk' WHEN k = 5 THEN 'quote differs from the chunk' WHEN k = 6 THEN 'unknown category' END AS reason FROM r)"""

SQL = {
    "scan_results": _CHECKED + " SELECT message, message || ':' || start AS chunk_id, reason, CASE WHEN reason IS NULL THEN (a >= 0)::INT + (b >= 0)::INT END AS n FROM v",
    "scan_messages": _CHECKED + """, f AS (SELECT DISTINCT message, start + a AS s, start + a + 3 AS e, 'name' AS category FROM v WHERE reason IS NULL AND a >= 0 UNION SELECT DISTINCT message, start + b, start + b + 2, 'place' FROM v WHERE reason IS NULL AND b >= 0),
o AS (SELECT *, s < max(e) OVER (PARTITION BY message ORDER BY s, e DESC, category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS meets FROM f),
m AS (SELECT message, count(*) AS wanted FROM c GROUP BY 1), h AS (SELECT message, count(*) AS had, min(reason) AS reason, max(CASE WHEN k <> 7 THEN message % 5 = 0 END) AS review FROM v GROUP BY 1), x AS (SELECT message, bool_or(coalesce(meets, false)) AS clash, count(*) AS n, sum(s)::BIGINT AS places FROM o GROUP BY 1),
j AS (SELECT *, CASE WHEN reason IS NOT NULL THEN reason WHEN coalesce(had, 0) < wanted THEN 'a chunk has no result' WHEN clash THEN 'findings conflict' END AS why FROM m LEFT JOIN h USING (message) LEFT JOIN x USING (message))
SELECT message, CASE WHEN why IS NULL THEN 'accepted' ELSE 'refused' END AS state, why AS reason, coalesce(review, false) AS review, CASE WHEN why IS NULL THEN n END AS n, CASE WHEN why IS NULL THEN places END AS places FROM j""",
}
