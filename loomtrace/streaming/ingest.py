"""Streaming ingestion: captures, and attribution that late evidence revises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.operators.merge import attribute_traces
from loomtrace.sources import sinks

#: Folders that the spans of an epoch are dealt to by trace.
FOLDERS = 64


def capture_files(spark: SparkSession, source: str, path: str, checkpoint: str, files_each: int = 100) -> None:
    """Capture every file that lands in a folder; ``files_each`` bounds a batch."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_each).load(source)
    q = stream.select(F.lit("rollout").alias("source"), "content").writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, epoch: sinks.capture(batch, path, epoch)).start()
    q.awaitTermination()


def attribute_stream(spark: SparkSession, source: str, path: str, checkpoint: str, files_each: int = 1) -> DataFrame:
    """Spans (id, trace_id, identity; JSON files) attributed as they come: each batch attributes the traces it touches anew, from all of their spans so far.

    A span's owner is that of its latest epoch, so evidence that comes late moves
    earlier spans and evidence that conflicts takes the inference back. Epoch
    folders are overwritten, so a repeated batch does no harm.
    """
    schema = "id long, trace_id string, identity string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).json(source)

    def put(batch: DataFrame, epoch: int) -> None:
        folder = F.pmod(F.xxhash64("trace_id"), F.lit(FOLDERS)).cast("int").alias("folder")
        batch.select("*", folder).write.mode("overwrite").partitionBy("folder").parquet(f"{path}/spans/epoch={epoch}")
        # spans lie in folders by a hash of their trace: a batch reads those of its own traces only
        touched = batch.select(folder, "trace_id").distinct()
        folders = [r[0] for r in touched.select("folder").distinct().collect()]  # FOLDERS at most
        spans = spark.read.schema(f"{schema}, epoch int, folder int").parquet(f"{path}/spans").where(F.col("folder").isin(folders) & (F.col("epoch") <= epoch)).dropDuplicates(["id"])
        attribute_traces(spans.join(touched.select("trace_id"), "trace_id", "left_semi")).write.mode("overwrite").parquet(f"{path}/owners/epoch={epoch}")

    q = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(put).start()
    q.awaitTermination()
    owners = spark.read.schema("id long, owner string, basis string, epoch int").parquet(f"{path}/owners")
    return owners.groupBy("id").agg(F.max_by(F.struct("owner", "basis"), "epoch").alias("x")).select("id", "x.*")
