"""Captures, their outcomes and what is derived from them anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20


def with_outcome(captures: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Captures (capture_id) with status, result and error of their latest outcome (capture_id, sequence, result, error): pending, normalized or failed."""
    latest = outcomes.groupBy("capture_id").agg(F.max_by(F.struct("result", "error"), "sequence").alias("o"))
    j = captures.join(latest, "capture_id", "left")
    status = F.when(F.col("o").isNull(), "pending").when(F.col("o.error").isNotNull(), "failed").otherwise("normalized")
    return j.withColumns({"status": status, "result": F.col("o.result"), "error": F.col("o.error")}).drop("o")


def page(rows: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The ``limit`` rows after a key, in order, and next_cursor: the last one's key if more follow, else null."""
    found = rows.where(F.col(key) > after).orderBy(key).limit(limit + 1)
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # limit + 1 rows
    cursor = F.when(F.count("*").over(w) > limit, F.get(F.collect_list(key).over(w), F.lit(limit - 1)))
    placed = found.withColumns({"next_cursor": cursor, "place": F.row_number().over(Window.orderBy(key))})
    return placed.where(F.col("place") <= limit).drop("place")


def chunks(payloads: DataFrame, key: str, size: int = CHUNK_BYTES) -> DataFrame:
    """key, chunk, length, sha256 of the pieces of ``content`` (binary) that an export sends; none of an empty one."""
    n = F.ceil(F.octet_length("content") / size).cast("int")
    rows = payloads.where(F.octet_length("content") > 0).select(key, "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    part = F.substring("content", F.col("chunk") * size + 1, F.lit(size))
    return rows.select(key, "chunk", F.octet_length(part).alias("length"), F.sha2(part, 256).alias("sha256"))


def reconciled(stored: DataFrame, incoming: DataFrame, old_lines: DataFrame, new_lines: DataFrame) -> DataFrame:
    """Derived rows of sessions after a file has come again, perhaps longer.

    stored, incoming: session_id, id, sequence, value; lines: session_id, sequence, sha256.
    A session of which a line is another now is left as it was. In others the rows of
    the lines that came are derived anew: stale ones go, later ones stay. ``change`` says
    what happened: kept, deleted, inserted, updated, unchanged or conflict.
    """
    conflict = new_lines.select("session_id", "sequence", F.col("sha256").alias("new")).join(old_lines, ["session_id", "sequence"]).where("new != sha256").select("session_id").distinct().withColumn("conflict", F.lit(True))
    upto = new_lines.groupBy("session_id").agg(F.max("sequence").alias("upto"))
    s = stored.select("session_id", "id", F.col("sequence").alias("old_sequence"), F.col("value").alias("was"))
    i = incoming.select("session_id", "id", F.col("sequence").alias("new_sequence"), F.col("value").alias("now"))
    j = s.join(i, ["session_id", "id"], "full").join(upto, "session_id", "left").join(conflict, "session_id", "left")
    had, came = F.col("old_sequence").isNotNull(), F.col("new_sequence").isNotNull()
    change = (
        F.when(F.col("conflict"), F.when(had, "conflict")).when(had & ~came, F.when(F.col("old_sequence") <= F.col("upto"), "deleted").otherwise("kept"))
        .when(~had, "inserted").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("updated")
    )
    value = F.when(change.isin("inserted", "updated"), F.col("now")).otherwise(F.col("was"))
    return j.select("session_id", "id", change.alias("change"), value.alias("value")).where("change IS NOT NULL")


def raw_links(links: DataFrame, events: DataFrame, lines: DataFrame) -> DataFrame:
    """event_id, import_id, sequence, sha256 of the raw lines that an event came from (links: event_id, import_id, sequences, normalized).

    A link holds while what it normalized to is what the event is; events that were
    inferred between lines have none.
    """
    inferred = F.coalesce(F.col("timing") == "estimated", F.lit(False))
    sound = links.join(events.select(F.col("id").alias("event_id"), "value", inferred.alias("inferred")), "event_id").where("NOT inferred AND normalized <=> value")
    wanted = sound.select("event_id", "import_id", F.explode("sequences").alias("sequence"))
    return wanted.join(lines, ["import_id", "sequence"]).select("event_id", "import_id", "sequence", "sha256")


def produced(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """Sessions with the producer that the last change set or, with a null, cleared; evidence counts go where it was cleared (changes: session_id, sequence, producer)."""
    last = changes.groupBy("session_id").agg(F.max_by(F.struct("producer"), "sequence").alias("c"))
    j = sessions.join(last, "session_id", "left")
    cleared = F.col("c").isNotNull() & F.col("c.producer").isNull()
    return j.select("session_id", F.when(F.col("c").isNotNull(), F.col("c.producer")).otherwise(F.col("producer")).alias("producer"), F.when(cleared, 0).otherwise(F.col("evidence")).alias("evidence"))


def occurrences(texts: DataFrame, key: str, quote: str) -> DataFrame:
    """key, start of every occurrence of a quote in ``text``, overlapping ones too, by splitting before each."""
    pieces = F.split("text", F.concat(F.lit("(?=\\Q" + quote + "\\E)")), -1)
    begins = F.startswith("text", F.lit(quote)).alias("begins")
    rows = texts.where(F.contains("text", F.lit(quote))).select(key, begins, F.posexplode(pieces).alias("pos", "piece"))
    before = F.coalesce(F.sum(F.length("piece")).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # each piece but the first begins with one
    return rows.select(key, before.cast("int").alias("start"), ((F.col("pos") > 0) | F.col("begins")).alias("here")).where("here").drop("here")


def merged_findings(findings: DataFrame, key: str) -> DataFrame:
    """Findings (start, end, category) of a text in order, each kept, contained in an earlier one of its category, or a conflict with what overlaps it."""
    w = Window.partitionBy(key).orderBy("start", F.desc("end"), "category").rowsBetween(Window.unboundedPreceding, -1)
    holder = F.max(F.struct("end", "category")).over(w)
    rows = findings.select(key, "start", "end", "category").distinct().withColumn("h", holder)
    overlaps = F.coalesce(F.col("start") < F.col("h.end"), F.lit(False))
    state = F.when(~overlaps, "kept").when((F.col("end") <= F.col("h.end")) & (F.col("category") == F.col("h.category")), "contained").otherwise("conflict")
    return rows.select(key, "start", "end", "category", state.alias("state"))


def wall_ms(text: Column) -> Column:
    """Milliseconds of a reported wall time in seconds, else null (a fixed form of tool output)."""
    seconds = F.regexp_extract(text, r"(?i)Wall time:\s*([\d.]+)\s*seconds", 1)
    return F.when(seconds != "", seconds.try_cast("double") * 1000)
