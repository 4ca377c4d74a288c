"""Interval measures: summed and active time, overlap groups, concurrency.

Intervals have start_us and end_us (null: open). Each function shuffles once on
its keys; running maxima replace self joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def measure(events: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: n, n_closed, sum_ms and active_ms, the length of the union; both null without a closed interval.

    An interval adds what reaches beyond the latest end before it.
    """
    w = Window.partitionBy(*keys).orderBy("start_us", "end_us", "id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest("start_us", F.max("end_us").over(w))
    rows = events.withColumn("fresh", F.when(F.col("end_us").isNotNull(), F.greatest(F.lit(0), F.col("end_us") - seen)))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count("end_us").alias("n_closed"), (F.sum(F.col("end_us") - F.col("start_us")) / 1000.0).alias("sum_ms"), (F.sum("fresh") / 1000.0).alias("active_ms"))


def islands(events: DataFrame, keys: list[str]) -> DataFrame:
    """Closed intervals of positive length with ``island``: a new one begins where start reaches the latest end before."""
    rows = events.where("end_us > start_us")
    order = Window.partitionBy(*keys).orderBy("start_us", "end_us", "id")
    before = F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", (before.isNull() | (F.col("start_us") >= before)).cast("int"))
    return rows.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def overlap_groups(events: DataFrame, keys: list[str], label_keys: list[str]) -> DataFrame:
    """Islands of two or more, labelled P1, P2, ... in order of (start, first id) within label_keys."""
    groups = islands(events, keys).groupBy(*keys, "island").agg(F.count("*").alias("size"), F.min("start_us").alias("group_start"), F.max("end_us").alias("group_end"), F.min(F.struct("start_us", "end_us", "id")).alias("first"))
    groups = groups.where("size > 1").withColumn("first_id", F.col("first.id"))
    rank = F.row_number().over(Window.partitionBy(*label_keys).orderBy("group_start", "first_id"))
    return groups.withColumn("label", F.concat(F.lit("P"), rank.cast("string"))).drop("first", "island")


def concurrency(events: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: peak number of intervals at once and ms with two or more; opens and closes of an instant are netted."""
    rows = events.where("end_us > start_us")
    edges = rows.select(*keys, F.explode(F.array(F.struct(F.col("start_us").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("end_us").alias("at"), F.lit(-1).alias("delta")))).alias("e"))
    net = edges.groupBy(*keys, F.col("e.at").alias("at")).agg(F.sum("e.delta").alias("delta"))
    w = Window.partitionBy(*keys).orderBy("at")
    steps = net.withColumn("active", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("until", F.lead("at").over(w))
    return steps.groupBy(*keys).agg(F.max("active").alias("peak"), (F.sum(F.when(F.col("active") >= 2, F.col("until") - F.col("at")).otherwise(0)) / 1000.0).alias("overlap_ms"))


def session_stats(events: DataFrame) -> DataFrame:
    """Per session: events, kinds, sources, extent and elapsed_ms, and how many rows a timeline shows."""
    last = F.max(F.coalesce("end_us", "start_us"))
    return events.groupBy("session_id").agg(
        F.count("*").alias("n_events"), F.size(F.collect_set("kind")).cast("long").alias("n_kinds"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min("start_us").alias("first_us"),
        last.alias("last_us"), ((last - F.min("start_us")) / 1000.0).alias("elapsed_ms"), F.count_if(on_timeline()).alias("timeline_count"),
    )


def on_timeline():
    """Shown whatever its end for clicks and views; others once closed."""
    return F.col("kind").isin("click", "view") | F.col("end_us").isNotNull()
