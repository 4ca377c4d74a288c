"""URL filters with redirect equivalence, in DataFrame operations only.

Rules (allow or block, a host and a path prefix) judge a url by its host, the
hosts above it and its path; the longest rule that fits wins. Redirects and
canonical links make urls aliases: connected components over those edges carry
a block to every url of the component that no rule names itself. A url's own
rule comes first, so an explicit allow stands against its aliases' block. What
neither a rule nor an alias decides is allowed.

Cases: a null url, or one without ``://``, has empty host and path and is
allowed. Null html has no links. Repeated rows are judged alike. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.shared import table, written
from loomtrace.operators.graph import components, dealt_anew

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: verdict, host, path: the rules of the registered query (fixed values).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Rules up to this many characters in all are sent to every task.
BROADCAST_CHARS = 4_000_000


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def node_of(rest: Column) -> Column:
    """A url's name in the link graph: host, path and query."""
    return F.concat(host_of(rest), F.regexp_extract(rest, "^[^/?#]*([^#]*)", 1))


def judged(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Add rule (host and path; null if none fits) and ruled (its verdict) to rows with host and path."""
    spark = urls.sparkSession
    listed = spark.createDataFrame([(f"{h}{p}", v, h, p) for v, h, p in rules], "rule string, ruled string, rule_host string, prefix string")
    hosts = urls.select("host").distinct()
    labels = F.split("host", "\\.")
    above = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("rule_host"))
    if sum(len(h) + len(p) for _, h, p in rules) <= BROADCAST_CHARS:
        listed = F.broadcast(listed)
    found = above.join(listed, "rule_host").groupBy("host").agg(F.collect_set(F.struct(F.length("rule").alias("size"), "rule", "ruled", "prefix")).alias("rules"))
    fit = F.array_max(F.filter("rules", lambda r: F.startswith("path", r["prefix"])))
    return urls.join(dealt_anew(found, "host"), "host", "left").withColumn("fit", fit).withColumns({"rule": F.col("fit.rule"), "ruled": F.col("fit.ruled")}).drop("rules", "fit")


def linked(pages: DataFrame) -> DataFrame:
    """u, v: urls that a canonical link or an immediate refresh in the html makes one (columns url, html)."""
    tag = F.regexp_extract("html", r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    canonical = F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    tag = F.regexp_extract("html", r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    refresh = F.regexp_extract(tag, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    some = pages.where("url IS NOT NULL AND html IS NOT NULL AND (html ILIKE '%canonical%' OR html ILIKE '%refresh%')")
    links = some.select("url", F.explode(F.array(canonical, refresh)).alias("href")).where("href != ''")
    rest = after_scheme(F.col("url"))
    folder = F.regexp_replace(path_of(rest), "[^/]*$", "")
    target = (
        F.when(F.instr("href", "://") > 0, after_scheme(F.col("href")))
        .when(F.startswith("href", F.lit("//")), F.substr("href", F.lit(3)))
        .when(F.startswith("href", F.lit("/")), F.concat(host_of(rest), "href"))
        .otherwise(F.concat(host_of(rest), F.when(folder == "", "/").otherwise(folder), "href"))
    )
    return links.select(node_of(rest).alias("u"), node_of(target).alias("v")).where("u != '' AND v != '' AND u != v").distinct()


def verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, by_alias (whether an alias decided) of each page.

    ``redirects``: further edges, columns from_url and to_url.
    """
    edges = linked(pages)
    if redirects is not None:
        ends = redirects.select(node_of(after_scheme(F.col("from_url"))).alias("u"), node_of(after_scheme(F.col("to_url"))).alias("v"))
        edges = edges.unionByName(ends.where("u != '' AND v != ''"))
    edges = written(edges, "url-links")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    blocked = judged(nodes.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}), rules).where("ruled = 'block'").select("node")
    of = nodes.join(components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    of = written(of, "url-components")
    bad = of.join(blocked, "node", "left_semi").select("component").distinct()
    aliases = of.join(bad, "component", "left_semi").select("node", F.lit(True).alias("by_alias"))
    rest = after_scheme(F.col("url"))
    rows = pages.select("page_id", host_of(rest).alias("host"), path_of(rest).alias("path"), node_of(rest).alias("node"))
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path", "node")})
    rows = judged(rows, rules).join(aliases, "node", "left")
    alias = F.coalesce("by_alias", F.lit(False)) & F.col("ruled").isNull()
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(alias, "block").otherwise("allow")).alias("verdict"), alias.alias("by_alias"))


def op4_redirect_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)


_LIST = ", ".join(f"('{h}{p}', '{v}', '{h}', '{p}')" for v, h, p in RULES)

QUERIES = {"op4_redirect_url_filter": op4_redirect_url_filter}
SQL = {
    "op4_redirect_url_filter": f"""
WITH RECURSIVE rules(rule, ruled, rule_host, prefix) AS (VALUES {_LIST}),
parts AS (
  SELECT page_id, html, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages
), named AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM parts
), hrefs AS (
  SELECT host, path, host || tail AS u, unnest([
    regexp_extract(regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>', 0), '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>', 0), '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1)]) AS href
  FROM named WHERE host || tail <> ''
), targets AS (
  SELECT u, CASE WHEN strpos(href, '://') > 0 THEN substr(href, strpos(href, '://') + 3) WHEN starts_with(href, '//') THEN substr(href, 3)
    WHEN starts_with(href, '/') THEN host || href
    ELSE host || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || href END AS t
  FROM hrefs WHERE href <> ''
), edges AS (
  SELECT DISTINCT u, translate(regexp_extract(t, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') || regexp_extract(t, '^[^/?#]*([^#]*)', 1) AS v FROM targets
), both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
bad AS (
  SELECT node FROM (
    SELECT node, arg_max(ruled, length(rule)) AS ruled FROM (SELECT DISTINCT u AS node FROM both_ways) n, rules
    WHERE (regexp_extract(node, '^([^/?#]*)', 1) = rule_host OR ends_with(regexp_extract(node, '^([^/?#]*)', 1), '.' || rule_host))
      AND starts_with(regexp_extract(node, '^[^/?#]*([^?#]*)', 1), prefix) GROUP BY node)
  WHERE ruled = 'block'
), reached AS (SELECT node FROM bad UNION SELECT v FROM reached JOIN both_ways ON u = node),
fitted AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(ruled, length(rule)) AS ruled
  FROM (SELECT DISTINCT host, path FROM named) x JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, prefix)
  GROUP BY host, path
)
SELECT page_id, n.host, n.path, rule, coalesce(ruled, CASE WHEN r.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       ruled IS NULL AND r.node IS NOT NULL AS by_alias
FROM named n LEFT JOIN fitted f ON f.host = n.host AND f.path = n.path LEFT JOIN reached r ON r.node = n.host || n.tail
"""
}
