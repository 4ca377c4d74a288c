"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace.sources.storage import Scratch, new_path, table, written

__all__ = ["Scratch", "added", "bucketed", "crc_remainder", "held_out", "new_path", "partitions", "table", "without", "written"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(n_rows: int, rows_each: int) -> int:
    return max(1, -(-n_rows // rows_each))


def crc_remainder(doc_id):
    """crc32 of the id written as text, modulo 3."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3))


def held_out(doc_id):
    """Whether a row is kept from training; one without an id is not."""
    return F.coalesce(crc_remainder(doc_id) == 1, F.lit(False))


def without(df: DataFrame, names: set[str]) -> DataFrame:
    """Less the columns that are named like one of ``names``, whatever the case of letters."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])


def added(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of ``df`` and further columns."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])
