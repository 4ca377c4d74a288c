"""Token usage: counters, first-wins records, running totals, exact prices, rollups.

Rows have session_id and line_number; a missing count is unknown, never zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counter_deltas(rows: DataFrame, counter: str) -> DataFrame:
    """What a cumulative counter adds at each row: equal neighbours are one reading; a fall is a reset, which adds nothing and is the new base; zero isn't kept."""
    w = Window.partitionBy("session_id").orderBy("line_number")
    seen = rows.withColumn("prior", F.lag(counter).over(w)).where(F.col("prior").isNull() | (F.col(counter) != F.col("prior")))
    base = F.lag(counter).over(w)
    delta = F.when(base.isNull(), F.col(counter)).when(F.col(counter) >= base, F.col(counter) - base)
    return seen.withColumn("delta", delta).withColumn("reset", F.coalesce(F.col(counter) < base, F.lit(False))).drop("prior").where("reset OR delta > 0")


def first_wins(rows: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """The first row of each key by line, with how many repeats were identical and how many conflicted."""
    first = F.min_by(F.struct("line_number", *payload), "line_number").over(Window.partitionBy(*key))
    marked = rows.withColumn("first", first)
    same = F.lit(True)
    for c in payload:
        same = same & F.col(c).eqNullSafe(F.col(f"first.{c}"))
    later = F.col("line_number") > F.col("first.line_number")
    return marked.groupBy(*key).agg(F.min("line_number").alias("line_number"), *(F.first(f"first.{c}").alias(c) for c in payload), F.count_if(later & same).alias("identical"), F.count_if(later & ~same).alias("conflicting"))


def known_sum(column: str):
    """Null if any value is unknown."""
    return F.when(F.count("*") == F.count(column), F.sum(column))


def priced(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Exact cost of each row, or the first reason that it has none. The rate card is a small dimension, sent to all tasks.

    Long context: more input than the model's threshold raises both prices.
    """
    j = rows.join(F.broadcast(rates), "model", "left")
    one = F.lit("1.00").cast("decimal(4,2)")
    long = F.coalesce(F.col("input_tokens") > F.col("long_over"), F.lit(False))
    up_in, up_out = F.when(long, F.col("long_input")).otherwise(one), F.when(long, F.col("long_output")).otherwise(one)
    count = lambda c: c.cast("decimal(12,0)")
    unit = F.lit("0.000001").cast("decimal(6,6)")
    part = lambda n, rate, up: (count(n) * F.col(rate) * up * unit).cast("decimal(38,14)")
    plain = F.col("input_tokens") - F.col("cached_tokens")
    reason = (
        F.when(F.col("input_rate").isNull(), "no rate")
        .when(F.col("cached_tokens").isNull(), "unknown cached tokens")
        .when(plain < 0, "more cached than input")
        .when(F.col("cached_rate").isNull() & (F.col("cached_tokens") > 0), "no cached rate")
    )
    cost = part(plain, "input_rate", up_in) + part(F.col("output_tokens"), "output_rate", up_out) + F.when(F.col("cached_tokens") > 0, part(F.col("cached_tokens"), "cached_rate", up_in)).otherwise(F.lit(0).cast("decimal(38,14)"))
    out = j.withColumns({"reason": reason, "long_context": long})
    return out.withColumn("cost", F.when(F.col("reason").isNull(), cost.cast("decimal(28,14)"))).drop("input_rate", "cached_rate", "output_rate", "long_over", "long_input", "long_output")


def running(rows: DataFrame) -> DataFrame:
    """Running tokens and running cost (null until the first priced row) in line order."""
    w = Window.partitionBy("session_id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"running_input": F.sum("input_tokens").over(w), "running_output": F.sum("output_tokens").over(w), "running_cost": F.sum("cost").over(w)})


def rollup(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count("*").alias("records"), F.sum("input_tokens").alias("input_tokens"), known_sum("cached_tokens").alias("cached_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("cost").alias("priced"),
        F.count_if(F.col("cost").isNull()).alias("unpriced"), F.sum("cost").cast("decimal(38,14)").alias("cost"), coverage().alias("coverage"),
    )


def coverage():
    """recorded, partial or unavailable: whether all, some or no rows have a price."""
    return F.when(F.count("cost") == F.count("*"), "recorded").when(F.count("cost") > 0, "partial").otherwise("unavailable")


def carried(rows: DataFrame, column: str, set_when) -> DataFrame:
    """The latest value of ``column`` among rows at or before each where ``set_when`` holds; a null set there counts."""
    w = Window.partitionBy("session_id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(set_when, F.struct(F.col(column).alias("v"))), ignorenulls=True).over(w)
    return rows.withColumn("carried", held["v"])


def checkpoint_mismatches(rows: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Checkpoints (session_id, line_number, total) that differ from the running total of rows up to and with their line."""
    both = rows.select("session_id", "line_number", F.lit(0).alias("kind"), F.col("input_tokens").alias("n"), F.lit(None).cast("long").alias("total"))
    both = both.unionByName(checkpoints.select("session_id", "line_number", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n"), "total"))
    w = Window.partitionBy("session_id").orderBy("line_number", "kind").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("running", F.sum("n").over(w))
    return got.where("kind = 1").where(~F.col("total").eqNullSafe(F.col("running"))).select("session_id", "line_number", "total", "running")
