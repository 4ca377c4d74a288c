"""Spans and log records: values, identities, kinds, times and the sessions they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.operators.graph import dealt_anew
from loomtrace.operators.turns import nearest_identity
from loomtrace.sources.storage import written

#: Keys that name a conversation, in order, and those that do if they hold a UUID (fixed values).
IDENTITY_KEYS, UUID_KEYS = ("session.id", "conversation.id", "gen_ai.conversation.id"), ("thread.id", "thread_id")
_UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
#: What an identity rests on is named by fixed values, here and in ``attributed``.
#: Operations of a language model (fixed values).
LLM_OPERATIONS = ("chat", "text_completion", "generate_content")


def any_values(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, name, type, value (text) of the attributes in JSON: a list of name and typed value; lists stay JSON, key-value lists are opened, however deep, under dotted names."""
    item = "STRUCT<key: STRING, value: STRUCT<stringValue: STRING, intValue: STRING, doubleValue: DOUBLE, boolValue: BOOLEAN, arrayValue: STRING, kvlistValue: STRING>>"
    opened = lambda json: F.explode(F.from_json(json, f"ARRAY<{item}>")).alias("a")
    level = rows.select(key, opened(column)).select(key, F.col("a.key").alias("name"), "a.value")
    flat = None
    while True:
        level = written(level, "attributes")
        done = level.where("value.kvlistValue IS NULL")
        flat = done if flat is None else flat.unionByName(done)
        rest = level.where("value.kvlistValue IS NOT NULL")
        if rest.isEmpty():
            break
        inner = rest.select(key, F.col("name").alias("outer"), opened(F.get_json_object("value.kvlistValue", "$.values")))
        level = inner.select(key, F.concat("outer", F.lit("."), "a.key").alias("name"), "a.value")
    v = {k: F.col(f"value.{k}") for k in ("stringValue", "intValue", "doubleValue", "boolValue", "arrayValue")}
    kind = F.when(v["stringValue"].isNotNull(), "string").when(v["intValue"].isNotNull(), "int").when(v["doubleValue"].isNotNull(), "double").when(v["boolValue"].isNotNull(), "bool").when(v["arrayValue"].isNotNull(), "array").otherwise("null")
    # integers of 64 bits come as text
    text = F.coalesce(v["stringValue"], v["intValue"].cast("long").cast("string"), v["doubleValue"].cast("string"), v["boolValue"].cast("string"), v["arrayValue"])
    return flat.select(key, "name", kind.alias("type"), text.alias("value"))


def _identity(value) -> tuple[Column, Column]:
    """The identity that a getter of attributes gives, and the key it is from."""
    filled = lambda k: F.coalesce(value(k), F.lit("")) != ""
    uuid = lambda k: F.coalesce(value(k).rlike(_UUID), F.lit(False))
    found = [(filled(k), value(k), F.lit(k)) for k in IDENTITY_KEYS] + [(uuid(k), value(k), F.lit(f"{k} (UUID)")) for k in UUID_KEYS]
    return F.coalesce(*[F.when(c, v) for c, v, _ in found]), F.coalesce(*[F.when(c, b) for c, _, b in found])


def identified(records: DataFrame) -> DataFrame:
    """Add direct, basis and candidates to records with attribute maps resource, scope and record (the narrower wins) and events (an array of maps).

    Without an identity of its own a record takes the only one that its events name.
    """
    own, basis = _identity(lambda k: F.coalesce(*[F.try_element_at(level, F.lit(k)) for level in ("record", "scope", "resource")]))
    nested = F.array_distinct(F.array_compact(F.transform(F.coalesce("events", F.array().cast("array<map<string,string>>")), lambda m: _identity(lambda k: F.try_element_at(m, F.lit(k)))[0])))
    rows = records.withColumns({"own": own, "own_basis": basis, "nested": nested})
    alone = F.col("own").isNull() & (F.size("nested") == 1)
    candidates = F.array_sort(F.array_union("nested", F.array_compact(F.array("own"))))
    return rows.withColumns({"direct": F.coalesce("own", F.when(alone, F.get("nested", F.lit(0)))), "basis": F.coalesce("own_basis", F.when(alone, "span event conversation identity")), "candidates": candidates}).drop("own", "own_basis", "nested")


def attributed(spans: DataFrame) -> DataFrame:
    """session_id and basis of each span (trace_id, span_id, parent_span_id, direct, basis, candidates): its own identity, its nearest ancestor's, the only one in the trace, or the trace."""
    name = lambda c: F.struct("trace_id", F.col(c).alias("span"))
    nodes = spans.select(name("span_id").alias("id"), F.when(F.col("parent_span_id").isNotNull(), name("parent_span_id")).alias("parent"), F.col("direct").alias("identity"))
    # of repeated spans one stands for all
    nodes = nodes.groupBy("id").agg(F.min(F.struct("identity", "parent")).alias("n")).select("id", "n.parent", "n.identity")
    nearest = nearest_identity(nodes).where("identity IS NOT NULL").select("id", F.col("identity").alias("nearest"))
    only = spans.select("trace_id", F.explode("candidates").alias("c")).groupBy("trace_id").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low = high").select("trace_id", F.col("low").alias("only"))
    j = spans.withColumn("id", name("span_id")).join(nearest, "id", "left").join(only, "trace_id", "left")
    session = F.coalesce("direct", "nearest", "only", F.col("trace_id").cast("string"))
    basis = F.when(F.col("direct").isNotNull(), F.col("basis")).when(F.col("nearest").isNotNull(), "ancestor span conversation identity").when(F.col("only").isNotNull(), "unique conversation identity in trace").otherwise("unattributed trace")
    return j.select("trace_id", "span_id", session.alias("session_id"), basis.alias("basis"))


def classified(records: DataFrame) -> DataFrame:
    """Add kind, status, start_ns, end_ns and timing to records (signal, name, operation, tool_name, severity, success, status_code, at_ns, end_at_ns, duration_ms).

    A log's duration reaches back from its time; a negative one makes it ``invalid``.
    """
    tool = F.coalesce("tool_name", F.lit("")) != ""
    op, last = F.coalesce("operation", F.lit("")), F.element_at(F.split("name", "\\."), -1)
    request = last.isin("api_request", "websocket_request")
    span = F.when(tool | (op == "execute_tool") | F.contains(F.lower("name"), F.lit("tool")), "tool").when(op.isin(*LLM_OPERATIONS) | request, "llm").otherwise("event")
    log = F.when(last == "tool_result", "tool").when(request, "llm").when(last == "user_prompt", "user").otherwise("event")
    rows = records.withColumn("kind", F.when(F.col("signal") == "traces", span).otherwise(log))
    waits = F.element_at(F.split(F.when(tool, F.col("tool_name")).otherwise(F.col("name")), "\\."), -1) == "request_user_input"
    timed = (F.col("signal") == "logs") & F.col("duration_ms").isNotNull() & F.col("kind").isin("tool", "llm")
    rows = rows.withColumns({"timed": timed, "kind": F.when(waits & ((F.col("kind") == "tool") | (F.col("signal") == "traces")), "user_wait").otherwise(F.col("kind"))})
    bad = F.col("timed") & (F.col("duration_ms") < 0)
    back = F.floor(F.col("duration_ms") * 1_000_000).cast("long")
    failed = F.coalesce(F.col("status_code") == 2, F.lit(False)) | (F.lower(F.coalesce("success", F.lit("true"))) == "false") | F.coalesce(F.col("severity") >= 17, F.lit(False))
    timing = F.when(bad, "invalid").when(F.col("timed") | ((F.col("signal") == "traces") & F.col("end_at_ns").isNotNull()), "measured").otherwise("unknown")
    return rows.withColumns({
        "start_ns": F.when(F.col("timed") & ~bad, F.col("at_ns") - back).otherwise(F.col("at_ns")), "end_ns": F.when(F.col("timed") & ~bad, F.col("at_ns")).when(F.col("signal") == "traces", F.col("end_at_ns")),
        "timing": timing, "status": F.when(failed, "error").otherwise("ok"),
    }).drop("timed")


def item_bounds(items: DataFrame) -> DataFrame:
    """Add start_ns and end_ns to items (kind, started_at_ms, completed_at_ms, secs, nanos): epoch milliseconds, or a tool's reported duration back from its end."""
    end = F.col("completed_at_ms") * 1_000_000
    reported = (F.col("kind") == "tool") & (F.col("secs").isNotNull() | F.col("nanos").isNotNull())
    length = F.coalesce("secs", F.lit(0)) * 1_000_000_000 + F.coalesce("nanos", F.lit(0))
    known = F.col("started_at_ms").isNotNull() & F.col("completed_at_ms").isNotNull()
    return items.withColumns({"start_ns": F.when(known, F.when(reported, end - length).otherwise(F.col("started_at_ms") * 1_000_000)), "end_ns": F.when(known, end)})


def own_producer(own: list[str], *fields: str) -> Column:
    """``self`` where one of the fields names the application itself (a parameter)."""
    named = F.lit(False)
    for f in fields:
        named = named | F.coalesce(F.col(f).isin(*own), F.lit(False))
    return F.when(named, "self")


def inherited_parent(history_mode: str, forked_from: str, parent: str, source: str, origin: str) -> Column:
    """The parent that a subagent's paged history names thrice alike, else null."""
    f = F.col(forked_from)
    named = (F.col(history_mode) == "paginated") & (F.coalesce(f, F.lit("")) != "") & (f == F.col(parent)) & (f == F.col(origin)) & (F.col(source) == "subagent")
    return F.when(F.coalesce(named, F.lit(False)), f)


def buckets(events: DataFrame) -> DataFrame:
    """Sessions all of whose events are spans under the trace's own id (session_id, trace_id, source)."""
    own = F.coalesce((F.col("source") == "trace") & (F.col("session_id") == F.col("trace_id")), F.lit(False))
    return events.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(own).alias("own")).where("n = own").select("session_id", "n")


def composed(calls: DataFrame, items: DataFrame) -> DataFrame:
    """Calls and items of a session as one list: id, kind, status, merged_id, parent_id, start_us, end_us, text.

    calls: id, session_id, turn_id, call_id, kind, start_us, end_us, text; items also have
    parent_call_id. An item whose named parent is one call is its child. Else one whose
    call id is a single call's and a single item's, of the same kind, closed, is matched and
    takes the call's place; with calls but no such match it is ambiguous.
    """
    keys = ["session_id", "turn_id", "call_id"]
    named = F.col("call_id").isNotNull() & F.col("turn_id").isNotNull()
    of = calls.where(named).groupBy(*keys).agg(F.count("*").alias("calls"), F.min(F.struct("id", "kind", "text")).alias("call"))
    parents = of.where("calls = 1").select("session_id", "turn_id", F.col("call_id").alias("parent_call_id"), F.col("call.id").alias("parent"))
    same = items.withColumn("same", F.count("*").over(Window.partitionBy(*keys)))
    j = same.join(dealt_anew(of, *keys), keys, "left").join(parents, ["session_id", "turn_id", "parent_call_id"], "left")
    match = (F.col("calls") == 1) & (F.col("same") == 1) & (F.col("call.kind") == F.col("kind")) & F.col("end_us").isNotNull()
    status = F.when(F.col("parent").isNotNull(), "child").when(match, "matched").when(F.col("calls") > 0, "ambiguous").otherwise("unmatched")
    j = j.withColumn("status", status)
    merged = F.when(F.col("status") == "matched", F.col("call.id"))
    own = j.select("session_id", "id", "kind", "status", merged.alias("merged_id"), F.col("parent").alias("parent_id"), "start_us", "end_us", F.when(merged.isNotNull() & (F.coalesce("call.text", F.lit("")) != ""), F.col("call.text")).otherwise(F.col("text")).alias("text"))
    replaced = own.where("merged_id IS NOT NULL").select(F.col("merged_id").alias("old"), F.col("id").alias("new"))
    # a parent that was merged is the item that took its place
    own = own.join(replaced.toDF("parent_id", "instead"), "parent_id", "left").withColumn("parent_id", F.coalesce("instead", "parent_id")).drop("instead")
    rest = calls.join(replaced, F.col("id") == F.col("old"), "left_anti")
    rest = rest.select("session_id", "id", "kind", F.lit("unmatched").alias("status"), F.lit(None).cast(own.schema["merged_id"].dataType).alias("merged_id"), F.lit(None).cast(own.schema["parent_id"].dataType).alias("parent_id"), "start_us", "end_us", "text")
    return own.select(rest.columns).unionByName(rest)
