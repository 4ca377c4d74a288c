"""Operators over ordered turns: carries, budgets, splits, duplicates, pseudonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace.operators.ordering import row_numbers, with_exclusive_sum
from loomtrace.sources.storage import Written, new_path


def within_budget(turns: DataFrame, budget: int) -> DataFrame:
    """Turns as rendered (role: text), cut where the session's characters run out; ``kept`` is the prefix that fits."""
    rows = turns.withColumn("line", F.concat("role", F.lit(": "), "text", F.lit("\n")))
    w = Window.partitionBy("session_id").orderBy("index", "line").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget) - F.coalesce(F.sum(F.length("line")).over(w), F.lit(0))
    rows = rows.withColumn("room", left).where("room > 0")
    return rows.select("session_id", "index", F.substring("line", F.lit(1), F.col("room").cast("int")).alias("kept"), (F.length("line") > F.col("room")).alias("truncated"))


def chronological_split(groups: DataFrame, share: float = 0.15) -> DataFrame:
    """train, validation, test by (latest, group): the last max(1, round half even(n * share)) groups test, as many before them validate."""
    ranked = row_numbers(groups, [F.col("latest"), F.col("group_id")], "before")
    total = groups.agg(F.count("*").alias("total"))
    ranked = ranked.crossJoin(F.broadcast(total))  # one row
    hold = F.greatest(F.lit(1), F.bround(F.col("total") * F.lit(share), 0).cast("long"))
    at = F.col("before") + 1
    split = F.when(at > F.col("total") - hold, "test").when(at > F.col("total") - 2 * hold, "validation").otherwise("train")
    return ranked.select("group_id", "latest", split.alias("split"))


def split_overlaps(split: DataFrame, rows: DataFrame) -> DataFrame:
    """Of each split the first and last time of its rows (group_id, at), and whether it begins before the split before it ends."""
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", 1).otherwise(2)
    spans = rows.join(split.select("group_id", "split"), "group_id").groupBy("split").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))
    before = F.lag("last").over(Window.orderBy(order))  # three rows
    return spans.withColumn("overlaps", F.coalesce(F.col("first") < before, F.lit(False)))


def nearest_rank(rows: DataFrame, column: str, percents: list[int]) -> DataFrame:
    """Values at rank round half even((n - 1) * p / 100); from counts of values."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    placed = with_exclusive_sum(counts, [F.col("value")], "n", "before")
    total = counts.agg(F.sum("n").alias("total"))
    wanted = total.select(F.explode(F.array(*map(F.lit, percents))).alias("percent"), "total").withColumn("rank", F.bround((F.col("total") - 1) * F.col("percent") / 100.0, 0).cast("long"))
    hit = placed.join(F.broadcast(wanted), (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))  # a few percents
    return hit.select("percent", "value")


def pseudonyms(quotes: DataFrame) -> DataFrame:
    """Numbers of distinct quotes within a group, in order of first (doc_id, place)."""
    first = quotes.groupBy("group_id", "quote").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("times"))
    number = F.row_number().over(Window.partitionBy("group_id").orderBy("first"))
    return first.select("group_id", "quote", F.concat(F.lit("[EMAIL_"), number.cast("string"), F.lit("]")).alias("pseudonym"), "times")


def nearest_identity(nodes: DataFrame) -> DataFrame:
    """Each node's own identity, or that of its nearest ancestor that has one (columns id, parent, identity).

    Pointer jumping: each round doubles the distance looked over, until one finds no
    identity more: distances along a chain have no gaps, so none is further up.
    A round looks only for nodes that are open, without an identity but with a parent;
    settled ones are written once. Cycles without an identity give null.
    """
    spark, path, last = nodes.sparkSession, new_path(nodes.sparkSession, "ancestors"), 0
    step = nodes.select("id", "parent", "identity")
    schema = T.StructType([*step.schema.fields, T.StructField("round", T.IntegerType())])
    is_open = "identity IS NULL AND parent IS NOT NULL"
    while True:
        step.write.parquet(f"{path}/round={last}")
        own = spark.read.schema(step.schema).parquet(f"{path}/round={last}")
        at = spark.read.schema(schema).parquet(path).where(f"NOT ({is_open}) OR round = {last}")
        if last and own.where("identity IS NOT NULL").isEmpty():
            return at.select("id", "identity")
        up = at.select(F.col("id").alias("parent"), F.col("parent").alias("grand"), F.col("identity").alias("above"))
        step = own.where(is_open).join(up, "parent", "left").select("id", F.when(F.col("above").isNull(), F.col("grand")).alias("parent"), F.col("above").alias("identity"))
        last += 1


def without_end(nodes: DataFrame) -> DataFrame:
    """ids whose chain of parents never ends: in a cycle or leading into one (columns id, parent; parents are ids)."""
    rounds = Written(nodes.sparkSession, "chains")
    at = rounds.put(nodes.select("id", "parent").where("parent IS NOT NULL"))
    left = at.count()
    while left:
        up = at.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
        at = rounds.put(at.join(up, "parent").select("id", F.col("grand").alias("parent")))
        before, left = left, at.count()
        if left == before:
            break
    return at.select("id")


def previous(turns: DataFrame, column: str, out: str) -> DataFrame:
    """Add ``out``: ``column`` of the session's turn with the index before, null if there is none; of repeated turns the last in order of ``column``."""
    w = Window.partitionBy("session_id").orderBy("index").rangeBetween(-1, -1)
    return turns.withColumn(out, F.max(column).over(w))
