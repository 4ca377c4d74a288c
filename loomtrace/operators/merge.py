"""Upserts without a lakehouse: folds of deliveries and conflict-guarded joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.variants import json_set
from loomtrace.operators.graph import dealt_anew


def fold_sessions(deliveries: DataFrame) -> DataFrame:
    """One row a session: the last title that isn't the default, the earliest start, ``session`` identity once seen, the first producer.

    All policies are aggregates with map-side combining, so no session is folded in one task alone.
    """
    named = F.when(F.col("title") != F.col("session_id").cast("string"), F.struct("sequence", "title"))
    produced = F.when(F.col("producer").isNotNull(), F.struct("sequence", "producer"))
    out = deliveries.groupBy("session_id").agg(F.max(named)["title"].alias("named"), F.min("started_at").alias("started_at"), F.max((F.col("identity_kind") == "session").cast("int")).alias("real"), F.min(produced)["producer"].alias("producer"), F.count("*").alias("deliveries"))
    return out.select("session_id", F.coalesce("named", F.col("session_id").cast("string")).alias("title"), "started_at", F.when(F.col("real") == 1, "session").otherwise("trace").alias("identity_kind"), "producer", "deliveries")


def unique_matches(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left rows with match (matched, ambiguous or unmatched) and the right row's id where a key is unique on both sides."""
    mine = left.groupBy(*keys).agg(F.count("*").alias("left_n"))
    theirs = right.groupBy(*keys).agg(F.count("*").alias("right_n"), F.min("right_id").alias("right_id"))
    # a key may hold very many rows
    j = left.join(dealt_anew(mine, *keys), keys, "left").join(dealt_anew(theirs, *keys), keys, "left")
    one = (F.col("left_n") == 1) & (F.col("right_n") == 1)
    status = F.when(F.col("right_n").isNull(), "unmatched").when(one, "matched").otherwise("ambiguous")
    return j.withColumn("match", status).withColumn("right_id", F.when(F.col("match") == "matched", F.col("right_id"))).drop("left_n", "right_n")


def attribute_traces(spans: DataFrame) -> DataFrame:
    """owner and basis of each span (columns id, trace_id, identity): its own identity, the only one in its trace, or the trace itself."""
    only = spans.where("identity IS NOT NULL").groupBy("trace_id").agg(F.min("identity").alias("low"), F.max("identity").alias("high"))
    j = spans.join(dealt_anew(only, "trace_id"), "trace_id", "left")
    alone = F.col("low") == F.col("high")
    basis = F.when(F.col("identity").isNotNull(), "direct").when(alone, "only identity in trace").otherwise("trace")
    owner = F.coalesce("identity", F.when(alone, F.col("low")), F.concat(F.lit("trace:"), F.col("trace_id").cast("string")))
    return j.select("id", owner.alias("owner"), basis.alias("basis"))


def upsert_events(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored events with a delivery merged in (columns session_id, id, kind, start_us, end_us, text), as a full outer join.

    New events are inserted. A stored one keeps its values but for: an open end that
    the delivery closes; a tool that the delivery calls a user_wait; a text where the
    stored one is empty. ``change`` says which came first in that order.
    """
    keys = ["session_id", "id"]
    s = stored.select(*keys, *(F.col(c).alias(f"s_{c}") for c in ("kind", "start_us", "end_us", "text")), F.lit(True).alias("had"))
    i = incoming.select(*keys, *(F.col(c).alias(f"i_{c}") for c in ("kind", "start_us", "end_us", "text")), F.lit(True).alias("came"))
    j = s.join(i, keys, "full_outer")
    both = F.col("had") & F.col("came")
    closes = both & F.col("s_end_us").isNull() & F.col("i_end_us").isNotNull()
    waits = both & (F.col("s_kind") == "tool") & (F.col("i_kind") == "user_wait")
    fills = both & (F.coalesce("s_text", F.lit("")) == "") & (F.coalesce("i_text", F.lit("")) != "")
    change = F.when(F.col("had").isNull(), "inserted").when(closes, "closed").when(waits, "corrected").when(fills, "filled").otherwise("kept")
    return j.select(
        *keys, F.when(waits, F.col("i_kind")).otherwise(F.coalesce("s_kind", "i_kind")).alias("kind"), F.coalesce("s_start_us", "i_start_us").alias("start_us"),
        F.coalesce("s_end_us", "i_end_us").alias("end_us"), F.when(fills, F.col("i_text")).when(F.col("had"), F.col("s_text")).otherwise(F.col("i_text")).alias("text"), change.alias("change"),
    )


def bind_evidence(old: DataFrame, new: DataFrame) -> DataFrame:
    """Field evidence of owners after a re-read (columns owner, field, origin): fields that match keep the old row, stale ones go, new ones come."""
    o = old.select("owner", "field", F.col("origin").alias("was"))
    n = new.select("owner", "field", F.col("origin").alias("now"))
    j = o.join(n, ["owner", "field"], "full_outer")
    change = F.when(F.col("now").isNull(), "deleted").when(F.col("was").isNull(), "added").when(F.col("was") == F.col("now"), "kept").otherwise("replaced")
    return j.select("owner", "field", F.coalesce("now", "was").alias("origin"), change.alias("change"))


def write_classes(sessions: DataFrame, results: DataFrame) -> DataFrame:
    """Sessions with the results that may be written: none of a producer's own, none that is labelled already unless forced (columns session_id, producer, label; session_id, category, forced)."""
    j = sessions.join(results, "session_id", "left")
    own = F.col("producer").eqNullSafe("self")
    taken = F.col("label").isNotNull() & ~F.coalesce("forced", F.lit(False))
    outcome = F.when(F.col("category").isNull(), "none").when(own, "excluded").when(taken, "labelled").otherwise("written")
    return j.select("session_id", F.when(outcome == "written", F.col("category")).otherwise(F.col("label")).alias("label"), outcome.alias("outcome"))


#: Readers whose events say what a tool's input is for.
SCOPED_SOURCES = ("codex_jsonl", "codex_item")


def correct_scopes(stored: DataFrame, incoming: DataFrame, sources: tuple[str, ...] = SCOPED_SOURCES) -> DataFrame:
    """Stored events with kinds and input scopes corrected by a delivery of the same events (columns session_id, id, source, name, text, start_us, kind, attributes; incoming also input_scope).

    Only an event that is the same in all but kind and attributes is corrected, only one
    that is a tool, a wait for the user or an input request, and only where kind or
    scope differ. The scope goes to ``input_scope`` of its attributes (JSON); others stay.
    ``corrected`` says which.
    """
    same = ["session_id", "id", "source", "name", "text", "start_us"]
    scopes = incoming.where(F.col("input_scope").isNotNull() & F.col("source").isin(*sources))
    scopes = scopes.groupBy(*same).agg(F.max(F.struct(F.col("kind").alias("new_kind"), F.col("input_scope").alias("new_scope"))).alias("new"))
    j = stored.join(dealt_anew(scopes, "session_id", "id"), same, "left")
    asks = F.col("kind").isin("tool", "user_wait") | F.coalesce(F.get_json_object("attributes", "$.wait_type") == "input_request", F.lit(False))
    differs = (F.col("kind") != F.col("new.new_kind")) | ~F.get_json_object("attributes", "$.input_scope").eqNullSafe(F.col("new.new_scope"))
    corrected = F.coalesce(F.col("new").isNotNull() & asks & differs, F.lit(False))
    j = j.withColumn("corrected", corrected)
    put = json_set(F.coalesce("attributes", F.lit("{}")), ["input_scope"], F.regexp_extract(F.to_json(F.array("new.new_scope")), r"^\[(.*)\]$", 1))
    return j.select(*same, F.when(F.col("corrected"), F.col("new.new_kind")).otherwise(F.col("kind")).alias("kind"), F.when(F.col("corrected"), put).otherwise(F.col("attributes")).alias("attributes"), "corrected")
