"""Sinks: JSON Lines exports, split files, content-addressed captures, snapshots with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.operators.captures import with_outcome
from loomtrace.sources.storage import removed


def export_jsonl(rows: DataFrame, path: str, order: list[str]) -> None:
    """Rows as JSON Lines in order, part by part (range partitions, so any size)."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("ignoreNullFields", False).json(path)


def export_splits(rows: DataFrame, path: str) -> None:
    """One folder of JSON Lines a split."""
    rows.write.partitionBy("split").json(path)


def capture(deliveries: DataFrame, path: str, batch: int | None = None) -> int:
    """Add deliveries (source, content) as a batch: each payload's bytes once, every attempt logged with a capture_id. Returns the batch's number.

    Payloads that other batches stored are left out by an anti join on their hash. A
    batch that is given again overwrites itself, so a repeated one does no harm;
    without a number it is the next.
    """
    spark = deliveries.sparkSession
    stored = payloads(spark, path)
    if batch is None:
        last = stored.agg(F.max("batch")).first()[0] if stored is not None else None
        seen = attempts(spark, path)
        last = max(x for x in (last, seen.agg(F.max("batch")).first()[0] if seen is not None else None, -1) if x is not None)
        batch = last + 1
    rows = deliveries.select("source", F.sha2("content", 256).alias("sha256"), "content")
    new = rows.groupBy("source", "sha256").agg(F.any_value("content").alias("content"))
    new = new.select("source", "sha256", F.octet_length("content").cast("long").alias("byte_count"), "content")
    if stored is not None:
        new = new.join(stored.where(F.col("batch") != batch).select("source", "sha256"), ["source", "sha256"], "left_anti")
    new.write.mode("overwrite").parquet(f"{path}/payloads/batch={batch}")
    number = F.shiftleft(F.lit(batch).cast("long"), 48) + F.monotonically_increasing_id()
    rows.select(number.alias("capture_id"), "source", "sha256", F.current_timestamp().alias("captured_at")).write.mode("overwrite").parquet(f"{path}/attempts/batch={batch}")
    return batch


def finish(outcomes: DataFrame, path: str) -> None:
    """Append outcomes of captures (capture_id, result, error); the latest counts."""
    outcomes.select("capture_id", "result", "error", F.current_timestamp().alias("sequence")).write.mode("append").parquet(f"{path}/outcomes")


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Every attempt with status, result and error: pending until an outcome came."""
    found = _read(spark, f"{path}/outcomes")
    if found is None:
        found = spark.createDataFrame([], "capture_id long, result string, error string, sequence timestamp")
    return with_outcome(attempts(spark, path), found)


def payloads(spark: SparkSession, path: str) -> DataFrame | None:
    return _read(spark, f"{path}/payloads")


def attempts(spark: SparkSession, path: str) -> DataFrame | None:
    return _read(spark, f"{path}/attempts")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None  # nothing there yet


def replaced(rows: DataFrame, path: str) -> None:
    """Write JSON aside and put it in the place of what is there by renaming.

    A reader finds the old or the new whole, or, between the two renames, nothing; where
    that matters, publish a draft (``sources.drafts``).
    """
    spark, aside, before = rows.sparkSession, f"{path}.new", f"{path}.old"
    rows.write.mode("overwrite").json(aside)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    removed(spark, before)
    if files.exists(at):
        files.rename(at, at.suffix(".old"))
    if not files.rename(at.suffix(".new"), at):
        raise OSError(f"{path} could not be replaced")
    removed(spark, before)


def pinned(spark: SparkSession, path: str, pins: dict[str, str]) -> DataFrame:
    """The inventory of a folder, if every pinned file (name: SHA-256) is there as pinned; raises otherwise. The pins are a parameter."""
    now = inventory(spark, path)
    wanted = spark.createDataFrame(list(pins.items()), "name string, pin string")
    wrong = F.broadcast(wanted).join(now, "name", "left").where("NOT sha256 <=> pin").select("name").limit(5).collect()
    if wrong:
        raise ValueError(f"not as pinned: {', '.join(sorted(r.name for r in wrong))}")
    return now


def snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Copy tables and write a manifest: name, rows, digest (order-free, over whole rows)."""
    parts = []
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
        kept = df.sparkSession.read.parquet(f"{path}/{name}")
        parts.append(kept.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*kept.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest")))
    manifest = parts[0]
    for p in parts[1:]:
        manifest = manifest.unionByName(p)
    manifest.write.parquet(f"{path}/manifest")
    return manifest.sparkSession.read.parquet(f"{path}/manifest")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """name, length and SHA-256 of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_replace("path", f"^.*?{path.rstrip('/').split('/')[-1]}/", "").alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def altered(spark: SparkSession, path: str, sealed: DataFrame) -> DataFrame:
    """Files that a sealed inventory and a folder don't agree on: added, missing or changed."""
    now = inventory(spark, path).select("name", F.col("sha256").alias("now"))
    j = sealed.select("name", F.col("sha256").alias("was")).join(now, "name", "full_outer").where("NOT was <=> now")
    return j.select("name", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "missing").otherwise("changed").alias("state"))
