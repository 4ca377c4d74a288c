"""Where tables are read from and intermediate ones are written to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs on one machine (tests) a temporary
    folder is made and set; on a cluster each executor would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or _set_folder(spark)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomtrace-"))
        found = _set_folder(spark)
    return found.rstrip("/")


def _set_folder(spark: SparkSession) -> str | None:
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else None


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    return Written(df.sparkSession, name).put(df)


class Written:
    """Successive versions of one table, as a loop makes them: the version before goes once the next is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path = spark, name, None

    def put(self, df: DataFrame) -> DataFrame:
        before, self.path = self.path, new_path(self.spark, self.name)
        df.write.parquet(self.path)
        if before:
            removed(self.spark, before)
        return self.spark.read.schema(df.schema).parquet(self.path)


class Scratch:
    """What a job puts aside on its way: ``with Scratch(spark) as aside`` removes all of it at the end but what is kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.loops = spark, [], []

    def __enter__(self) -> "Scratch":
        return self

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """As ``written``, until the end."""
        path = new_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def rounds(self, name: str) -> Written:
        """Versions of a loop's table, the last one until the end."""
        self.loops.append(Written(self.spark, name))
        return self.loops[-1]

    def __exit__(self, *_) -> None:
        for path in [*self.paths, *(x.path for x in self.loops if x.path)]:
            removed(self.spark, path)
