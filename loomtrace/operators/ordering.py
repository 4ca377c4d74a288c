"""Order over a whole table: running totals and ranks without a single-task window over rows.

Rows are ranged by the order columns (Spark samples the ranges), so each partition
holds a stretch of the order. Partitions' totals, one row each, are summed up in
order; a row's total is its partition's base and what comes before it in there.
Where the order columns can be equal in very many rows, end them with one that
tells rows apart, so that a stretch of equal rows is split too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.sources.storage import written


def with_exclusive_sum(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` (a whole number) over all rows before a row."""
    ranged = written(df.repartitionByRange(*order).withColumn("stretch", F.spark_partition_id()), "ranged")
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    base = ranged.groupBy("stretch").agg(F.sum(value).alias("s")).select("stretch", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("own", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return rows.join(F.broadcast(base), "stretch").withColumn(out, F.col("own") + F.col("base")).drop("stretch", "own", "base")


def row_numbers(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Add ``out``: how many rows come before a row."""
    return with_exclusive_sum(df.withColumn("one row", F.lit(1)), order, "one row", out).drop("one row")
