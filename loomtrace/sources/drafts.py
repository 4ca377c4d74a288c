"""Several tables published as one draft: staged, sealed by a manifest, made current by one file.

A draft's outputs are written to a folder of their own; each that is whole has a
receipt, so a draft that was stopped goes on where it was. The manifest says of each
output how many rows it has and a sum of their hashes. What is current is said by
files named by their revision: a new one is created, never overwritten, and only by
who saw the revision before it, so of two writers one is refused. Readers see the
last revision's draft whole, or the one before it.

Layout: ``drafts/<name>/<output>``, ``drafts/<name>/receipts/<output>``,
``drafts/<name>/manifest``, ``revisions/<number>`` (the draft's name).

Cases: a table without rows is an output like any other. No revision yet is revision
0, of nothing. A draft's name is used once; publishing it again is refused as any
stale writer is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Stale(ValueError):
    """Another revision came first."""


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def _created(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; False if there is one."""
    fs, at = _fs(spark, path)
    try:
        out = fs.create(at, False)
    except Exception as error:
        if fs.exists(at):
            return False
        raise error
    out.write(bytearray(text.encode()))
    out.close()
    return True


def digest(rows: DataFrame) -> tuple[int, str]:
    """How many rows, and the sum of their hashes, whatever their order."""
    h = F.xxhash64(*[F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]))]).cast("decimal(38,0)")
    n, total = rows.agg(F.count("*"), F.sum(h)).first()
    return n, str(total or 0)


def revisions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Revisions and their drafts, in order. One that is being written has no name yet, and isn't there."""
    fs, at = _fs(spark, f"{path}/revisions")
    if not fs.exists(at):
        return []
    files = [f for f in fs.listStatus(at) if f.getLen() and not f.getPath().getName().startswith(".")]
    names = {int(f.getPath().getName()): f.getPath() for f in files}
    out = []
    for n in sorted(names):
        stream = fs.open(names[n])
        out.append((n, bytes(stream.readAllBytes()).decode()))
        stream.close()
    return out


def current(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """The last revision and its draft; 0 and None without one."""
    found = revisions(spark, path)
    return found[-1] if found else (0, None)


def publish(spark: SparkSession, path: str, name: str, outputs: dict[str, Callable[[], DataFrame]], seen: int) -> int:
    """Stage the outputs of a draft that aren't there yet, seal it and make it the revision after ``seen``. Returns its number.

    Outputs are given as functions, so that those with a receipt aren't computed again.
    Raises Stale if ``seen`` isn't the current revision, before or after the work.
    """
    if current(spark, path)[0] != seen:
        raise Stale(f"revision {seen} isn't current")
    folder = f"{path}/drafts/{name}"
    for output, made in outputs.items():
        if not _exists(spark, f"{folder}/receipts/{output}"):
            made().write.mode("overwrite").parquet(f"{folder}/{output}")
            _created(spark, f"{folder}/receipts/{output}", "whole")
    if not _exists(spark, f"{folder}/manifest/_SUCCESS"):
        rows = [(output, *digest(spark.read.parquet(f"{folder}/{output}"))) for output in sorted(outputs)]
        spark.createDataFrame(rows, "output string, n long, digest string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    if current(spark, path)[0] != seen or not _created(spark, f"{path}/revisions/{seen + 1:012d}", name):
        raise Stale(f"revision {seen + 1} came first")
    return seen + 1


def read(spark: SparkSession, path: str, output: str, revision: int | None = None) -> DataFrame:
    """An output of the current draft, or of an earlier revision's."""
    found = dict(revisions(spark, path))
    name = found[revision if revision is not None else max(found)]
    return spark.read.parquet(f"{path}/drafts/{name}/{output}")


def altered(spark: SparkSession, path: str) -> list[str]:
    """Outputs of the current draft that aren't what its manifest says."""
    name = current(spark, path)[1]
    folder = f"{path}/drafts/{name}"
    return [r.output for r in spark.read.parquet(f"{folder}/manifest").collect() if (r.n, r.digest) != digest(spark.read.parquet(f"{folder}/{r.output}"))]
