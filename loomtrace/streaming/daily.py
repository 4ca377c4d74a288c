"""Streaming jobs over event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.sources.storage import new_path


def daily_counts(spark: SparkSession, source: str) -> DataFrame:
    """Events by day and type, from a file stream with a watermark, run until the files are read.

    Complete mode: every batch replaces the counts before it, so retries do no harm.
    """
    schema = spark.read.parquet(source).schema
    out, state = new_path(spark, "daily-counts"), new_path(spark, "daily-counts-state")
    events = spark.readStream.schema(schema).parquet(source).withColumn("at", F.col("ts").cast("timestamp"))
    counts = events.withWatermark("at", "2 days").groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))

    def put(batch: DataFrame, epoch: int) -> None:
        batch.select(F.col("w.start").cast("date").cast("string").alias("day"), "event_type", "n").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = counts.writeStream.outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    rows = spark.read.schema("day string, event_type string, n long, epoch int").parquet(out)
    last = rows.agg(F.max("epoch").alias("epoch"))
    return rows.join(F.broadcast(last), "epoch").select("day", "event_type", "n")  # last: one row
