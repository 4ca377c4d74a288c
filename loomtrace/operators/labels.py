"""Label coverage, classification metrics and paired comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(pairs: DataFrame, classes: list[int]) -> DataFrame:
    """Counts of every (actual, predicted) pair of classes, zero where none."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(a, p) for a in classes for p in classes], "actual int, predicted int")
    counts = pairs.groupBy(F.col("actual").cast("int").alias("actual"), F.col("predicted").cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def metrics(pairs: DataFrame, classes: list[int]) -> DataFrame:
    """Per class: support, precision, recall, F1 (zero where undefined), with accuracy, macro and weighted F1 over all classes."""
    m = confusion(pairs, classes)
    cell = F.explode(F.array(F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("right")), F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("long").alias("right"))))
    by = m.select(cell.alias("c")).groupBy("c.class").agg(F.sum("c.support").alias("support"), F.sum("c.guessed").alias("guessed"), F.sum("c.right").alias("right"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    f1 = F.when(F.col("support") + F.col("guessed") > 0, 2.0 * F.col("right") / (F.col("support") + F.col("guessed"))).otherwise(0.0)
    by = by.select("class", "support", "right", ratio("right", "guessed").alias("precision"), ratio("right", "support").alias("recall"), f1.alias("f1"))
    total = by.agg((F.sum("right") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    out = by.crossJoin(F.broadcast(total)).drop("right")  # one row of totals
    return out.select("class", "support", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy", "macro_f1", "weighted_f1")))


def coverage(targets: DataFrame, labels: DataFrame, configurations: list[str]) -> DataFrame:
    """Per configuration, how many targets' labels are available, invalid or missing.

    labels: doc_id and a column a configuration; a value other than 0 and 1 is invalid.
    """
    j = targets.select("doc_id").join(labels.select("doc_id", *configurations, F.lit(True).alias("there")), "doc_id", "left")
    long = j.select("doc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("configuration"), F.when(F.col("there").isNull() | F.col(c).isNull(), "missing").when(F.col(c).isin(0, 1), "available").otherwise("invalid").alias("status")) for c in configurations])).alias("x"))
    return long.groupBy("x.configuration").agg(*(F.count_if(F.col("x.status") == s).alias(s) for s in ("available", "invalid", "missing")))
