"""Connected components as DataFrame operations.

Alternating large-star and small-star steps: every node links its larger, then
its smaller neighbours to the least node it sees, until each component is a
star around its least node. Minima are taken with map-side combining and joined
back, so a node with very many neighbours stays spread over tasks; rounds grow
with the logarithm of the longest chain. Each round is written to the shared
folder, and the one before removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace.sources.storage import Written, new_path


def dealt_anew(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows. A join with an aggregate of its own left side would use the aggregate's partitioning, and a key with
    very many rows would stay in one task; named anew, both sides are dealt for the join and adaptive execution splits such keys."""
    return df.withColumns({k: F.least(k, k) for k in keys})


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges``: columns u, v of one orderable type; nulls are ignored.

    Returns node, component for every node that isn't the least of its component
    (component: that least node). It ends when a round changes nothing.
    """
    e = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    rounds = Written(edges.sparkSession, "edges")
    e = rounds.put(e)
    before = _signature(e)
    if not before[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(dealt_anew(least, "u"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(dealt_anew(least, "u"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = rounds.put(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        if (after := _signature(e)) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = after


def dependencies(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """root, node, depth: everything that each root depends on over edges (node, needs), the root itself at depth 0.

    Semi-naive: each round follows the edges of what the last one found, and keeps
    only what is new to its root, so cycles end, and chains of any depth are followed.
    """
    spark = roots.sparkSession
    path = new_path(spark, "dependencies")
    new, depth = roots.select("root", F.col("root").alias("node")).distinct(), 0
    schema = T.StructType([*new.schema.fields, T.StructField("depth", T.IntegerType())])
    while True:
        # one folder a round: what is found so far is one scan, however many rounds there were
        new.write.parquet(f"{path}/depth={depth}")
        new = spark.read.schema(new.schema).parquet(f"{path}/depth={depth}")
        found = spark.read.schema(schema).parquet(path)
        if new.isEmpty():
            return found
        step = new.join(edges, "node").select("root", F.col("needs").alias("node")).distinct()
        new, depth = step.join(found, ["root", "node"], "left_anti"), depth + 1
