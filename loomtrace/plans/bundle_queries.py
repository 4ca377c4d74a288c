"""Queries of bundles and what they need."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import bundles as B
from loomtrace.sources.storage import table, written


def _parts(spark, sf_dir):
    """Regions, nations, suppliers and customers as bundles, a file each: a nation needs its region, the others their nation; two nations need each other."""
    r, n, s, c = (table(spark, sf_dir, x) for x in ("region", "nation", "supplier", "customer"))
    key = lambda letter, col: F.concat(F.lit(letter), F.col(col).cast("string"))
    rows = r.select(key("r", "r_regionkey").alias("id"), F.col("r_name").alias("x"), F.lit(None).cast("string").alias("needs"))
    rows = rows.unionByName(n.select(key("n", "n_nationkey").alias("id"), F.col("n_name").alias("x"), key("r", "n_regionkey").alias("needs")))
    rows = rows.unionByName(s.select(key("s", "s_suppkey").alias("id"), F.col("s_name").alias("x"), key("n", "s_nationkey").alias("needs")))
    rows = rows.unionByName(c.select(key("c", "c_custkey").alias("id"), F.col("c_name").alias("x"), F.when(F.col("c_custkey") % 50 == 0, "n99").otherwise(key("n", "c_nationkey")).alias("needs")))
    return rows.withColumn("sha", F.sha2("x", 256))


def bundle_closure(spark, sf_dir):
    """Bundles with what is wrong in them or below: an altered nation, two nations in a circle, old pins of some suppliers, customers of no nation."""
    p = written(_parts(spark, sf_dir), "parts")  # read six times
    bundles = p.select("id", F.lit("p").alias("project"), F.sha2(F.concat("id", "sha"), 256).alias("manifest_sha256"))
    entries = p.select("id", F.lit("data.json").alias("path"), F.length("x").cast("long").alias("bytes"), F.col("sha").alias("sha256"))
    found = entries.withColumn("sha256", F.when(F.col("id") == "n3", F.lit("0")).otherwise(F.col("sha256")))
    circle = p.where(F.col("id").isin("n5", "n6")).select("id", F.when(F.col("id") == "n5", "n6").otherwise("n5").alias("needs"))
    needs = p.where("needs IS NOT NULL").select("id", "needs").unionByName(circle)
    of = p.select(F.col("id").alias("needs"), "sha", F.sha2(F.concat("id", "sha"), 256).alias("manifest"))
    j = needs.join(of, "needs", "left")
    old, number = F.startswith("id", F.lit("s")), F.substring("id", 2, 20).cast("long")
    references = j.select("id", "needs", F.lit("p").alias("project"), F.when(old & (number % 9 == 0), "old").otherwise(F.col("manifest")).alias("manifest_sha256"), F.lit("data.json").alias("path"), F.when(old & (number % 7 == 0), "old").otherwise(F.col("sha")).alias("sha256"))
    return B.verified(bundles, entries, found, references)


QUERIES = {"bundle_closure": bundle_closure}

SQL = {
    "bundle_closure": """WITH p AS (SELECT 'r' || r_regionkey AS id, NULL AS needs FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'n99' ELSE 'n' || c_nationkey END FROM customer),
own AS (SELECT *, CASE WHEN id = 'n3' THEN 'files differ from the manifest' WHEN needs = 'n99' THEN 'needs no known bundle' WHEN id LIKE 's%' AND substr(id, 2)::BIGINT % 9 = 0 THEN 'pinned manifest or project differs'
  WHEN id LIKE 's%' AND substr(id, 2)::BIGINT % 7 = 0 THEN 'pinned file differs' END AS fault FROM p)
SELECT id, CASE WHEN fault IS NOT NULL THEN 'faulty' WHEN needs = 'n3' THEN 'needs faulty' WHEN id IN ('n5', 'n6') OR needs IN ('n5', 'n6') THEN 'in a cycle' ELSE 'sound' END AS state,
  CASE WHEN fault IS NOT NULL THEN fault WHEN needs = 'n3' THEN 'files differ from the manifest' END AS fault, CASE WHEN fault IS NOT NULL THEN id WHEN needs = 'n3' THEN 'n3' END AS member FROM own""",
}
