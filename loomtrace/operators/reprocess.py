"""Stored payloads interpreted again, by what they were captured from, and compared with what was derived before.

Each payload goes to the reader of its source: rollouts to records and events, trace
exports (JSON or binary) to spans. A payload that its reader refuses, that isn't
decoded within the limit, or whose source has no reader fails by itself. What a
payload gives is compared by a digest of its rows, in any order.

Cases: a null payload fails. A payload that gives no rows has digest 0. Two captures
of the same bytes are two results. Payloads are decoded one in a task's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.documents import decoded_body
from loomtrace.operators import otlp, rollout
from loomtrace.operators.graph import dealt_anew
from loomtrace.sources import rollout as source
from loomtrace.sources.storage import written

ROLLOUT, TRACES = "rollout", "otlp_traces"
EVENT = ("line_number", "turn_id", "kind", "name", "start_us", "end_us", "timing", "status")
SPAN = ("trace_id", "span_id", "parent_span_id", "name", "start_ns", "end_ns", "status_code")


def row_digest(*columns: str) -> Column:
    """60 bits of a row's values, nulls told from empty text."""
    text = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")


def digests(rows: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """key, n, digest: how many rows each key has, and the sum of their digests."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(row_digest(*columns)).alias("digest"))


def reprocessed(captures: DataFrame, before: DataFrame, limit: int, events=rollout.events) -> DataFrame:
    """capture_id, source, status, error, n, digest, change of each capture (capture_id, source, content_type, encoding, content).

    before: capture_id, digest of what was derived earlier. change: new, same or changed,
    null where it failed.
    """
    bodies = captures.withColumn("content", decoded_body(F.col("content"), F.coalesce("encoding", F.lit("identity")), limit))
    bodies = written(bodies.select("capture_id", "source", "content_type", "content"), "bodies")
    texts = bodies.where((F.col("source") == ROLLOUT) & F.col("content").isNotNull()).select(F.col("capture_id").alias("file"), F.col("content").cast("string").alias("value"))
    lines = source.lines_of(texts.select("file", "value"))
    records = written(source.records(lines), "records")
    made = digests(events(records, with_file=True), "file", EVENT).withColumnRenamed("file", "capture_id")
    sound = records.select(F.col("file").alias("capture_id")).distinct()
    rolls = sound.join(made, "capture_id", "left").withColumn("error", F.lit(None).cast("string"))

    exports = otlp.decoded(bodies.where((F.col("source") == TRACES) & F.col("content").isNotNull()))
    exports = written(exports, "exports")
    spans = digests(otlp.spans(exports), "capture_id", SPAN)
    traces = exports.select("capture_id", "error").join(spans, "capture_id", "left").select("capture_id", "n", "digest", "error")

    found = rolls.select("capture_id", "n", "digest", "error", F.lit(True).alias("read")).unionByName(traces.withColumn("read", F.col("error").isNull()))
    j = bodies.select("capture_id", "source", F.col("content").isNull().alias("lost")).join(dealt_anew(found, "capture_id"), "capture_id", "left")
    error = (
        F.when(~F.col("source").isin(ROLLOUT, TRACES) | F.col("source").isNull(), "no reader for the source").when(F.col("lost"), "not decoded within the limit")
        .when(F.coalesce("read", F.lit(False)), F.lit(None)).otherwise(F.coalesce("error", F.lit("refused by its reader")))
    )
    j = j.withColumn("error", error).join(dealt_anew(before.select("capture_id", F.col("digest").alias("earlier")), "capture_id"), "capture_id", "left")
    ok = F.col("error").isNull()
    digest = F.when(ok, F.coalesce("digest", F.lit(0)))
    change = F.when(ok, F.when(F.col("earlier").isNull(), "new").when(F.col("earlier") == digest, "same").otherwise("changed"))
    return j.select("capture_id", "source", F.when(ok, "normalized").otherwise("failed").alias("status"), "error", F.when(ok, F.coalesce("n", F.lit(0))).alias("n"), digest.cast("decimal(38,0)").alias("digest"), change.alias("change"))
