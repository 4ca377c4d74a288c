"""Leakage-free splits: whole groups, the best of many seeded deals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.operators.ordering import row_numbers

SPLITS = (("train", 70), ("validation", 15), ("test", 15))


def dealt(group: str, seed: str):
    """A group's split under a seed: the first 32 bits of an md5 in 100 parts."""
    h = F.conv(F.substring(F.md5(F.concat(F.col(seed).cast("string"), F.lit(":"), F.col(group).cast("string"))), 1, 8), 16, 10).cast("long") % 100
    return F.when(h < 70, "train").when(h < 85, "validation").otherwise("test")


def best_deal(groups: DataFrame, seeds: int = 512) -> DataFrame:
    """group_id, n, seed, split under the seed whose row counts are nearest to the ratios (columns group_id, n).

    Every seed's counts come from one aggregation; deals are compared by the sum of
    deviations in rows, ties to the smaller seed. Deals that leave a split empty come
    last; if all do, as with very few groups, the largest group trains, the next
    validates, the third tests and the rest train (seed null).
    """
    tried = groups.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    counts = tried.groupBy("seed").agg(F.sum("n").alias("total"), *(F.sum(F.when(dealt("group_id", "seed") == s, F.col("n")).otherwise(0)).alias(s) for s, _ in SPLITS))
    off = sum((F.abs(F.col(s) * 100 - F.col("total") * share) for s, share in SPLITS[1:]), F.abs(F.col("train") * 100 - F.col("total") * 70))
    empty = F.least(*(F.col(s) for s, _ in SPLITS)) == 0
    best = counts.agg(F.min(F.struct(empty.alias("empty"), off.alias("off"), "seed")).alias("best")).select("best.empty", "best.seed").first()
    if best.seed is not None and not best.empty:
        seed = F.lit(best.seed)
        return groups.withColumn("seed", seed).select("group_id", "n", "seed", dealt("group_id", "seed").alias("split"))
    largest = [r.group_id for r in groups.orderBy(F.desc("n"), "group_id").limit(3).collect()]
    split = F.when(F.col("group_id").isin(largest[1:2]), "validation").when(F.col("group_id").isin(largest[2:3]), "test").otherwise("train")
    return groups.select("group_id", "n", F.lit(None).cast("int").alias("seed"), split.alias("split"))


def support(rows: DataFrame, category: str) -> DataFrame:
    """Rows of each category in each split, with the category's share, and whether it has none there (columns split and ``category``)."""
    every = rows.select(category).distinct().crossJoin(rows.sparkSession.createDataFrame([(s,) for s, _ in SPLITS], "split string"))  # three splits
    n = rows.groupBy("split", category).agg(F.count("*").alias("n"))
    total = rows.groupBy(category).agg(F.count("*").alias("total"))
    out = every.join(n, ["split", category], "left").join(total, category).withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("split", category, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), (F.col("n") == 0).alias("unsupported"))


def bootstrap(groups: DataFrame, measure, replicates: int = 1000) -> DataFrame:
    """One row a replicate: ``measure`` over as many groups as there are, drawn with replacement (columns group_id and counts).

    A draw is a group's place in order of group_id, from an md5 of replicate and draw.
    """
    placed = row_numbers(groups, [F.col("group_id")], "place")
    n = groups.count()
    if not n:
        return groups.limit(0).groupBy(F.lit(0).alias("replicate")).agg(measure.alias("value"))
    spark = groups.sparkSession
    draws = spark.range(replicates).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    h = F.conv(F.substring(F.md5(F.concat(F.col("replicate").cast("string"), F.lit(":"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long")
    drawn = draws.groupBy("replicate", (h % n).alias("place")).agg(F.count("*").alias("times"))
    return drawn.join(placed, "place").groupBy("replicate").agg(measure.alias("value"))
