"""Events of rollouts by windows over their records, with no state carried in code.

What a reader of the file would remember is a running aggregate by line: the
session, the turn, whether a task is active, how many calls are open and since
when the model has had the word. Tool calls pair with outputs by the next record
of the same call id.

A file's windows sort its records once; all share one partitioning and order. The
same windows keep the line that each part of the state is from, so that ``evidence``
can say of every field of an event which values of which lines it came from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CALLS, OUTPUTS = ("function_call", "custom_tool_call"), ("function_call_output", "custom_tool_call_output")


def _last(value, window):
    return F.last(value, ignorenulls=True).over(window)


def marked(records: DataFrame) -> DataFrame:
    """Records with ``what`` (call, output, said, asked, started, ended, or null), session, turn, and the state before each."""
    kind, role = F.col("payload.type"), F.col("payload.role")
    what = (
        F.when((F.col("type") == "response_item") & kind.isin(*CALLS), "call")
        .when((F.col("type") == "response_item") & kind.isin(*OUTPUTS), "output")
        .when((F.col("type") == "response_item") & (kind == "message") & (role == "user"), "asked")
        .when((F.col("type") == "response_item") & kind.isin("message", "reasoning") & ~F.coalesce(role.isin("developer", "system"), F.lit(False)), "said")
        .when((F.col("type") == "event_msg") & (kind == "task_started"), "started")
        .when((F.col("type") == "event_msg") & kind.isin("task_complete", "turn_aborted"), "ended")
    )
    w = Window.partitionBy("file").orderBy("line_number")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    header = (F.col("type") == "session_meta") & F.col("payload.id").isNotNull()
    first = lambda c: F.first(F.when(header, F.col(c)), ignorenulls=True).over(upto)
    rows = records.withColumns({"what": what, "session_id": first("payload.id"), "session_line": first("line_number")})
    sets_turn = ((F.col("type") == "turn_context") | (F.col("what") == "started")) & F.col("payload.turn_id").isNotNull()
    rows = rows.withColumns({"turn_id": _last(F.when(sets_turn, F.col("payload.turn_id")), upto), "turn_line": _last(F.when(sets_turn, F.col("line_number")), upto)})
    # the next and the former record of the same call
    same = Window.partitionBy("file", "payload.call_id").orderBy("line_number")
    paired = F.col("what").isin("call", "output")
    by_call = rows.where(paired).select("file", "line_number", F.lead(F.struct("what", "line_number", "at_us", "payload.output")).over(same).alias("next"), F.lag("what").over(same).alias("former"))
    rows = rows.join(by_call, ["file", "line_number"], "left")
    final = F.col("payload.phase") == "final_answer"
    active = F.when(F.col("what").isin("asked", "started"), True).when((F.col("what") == "ended") | (F.col("what") == "said") & F.coalesce(final, F.lit(False)), False)
    # a call id used again takes the place of the call before
    opened = F.when((F.col("what") == "call") & (F.coalesce("former", F.lit("")) != "call"), 1).when((F.col("what") == "output") & (F.col("former") == "call"), -1).otherwise(0)
    rows = rows.withColumns({"active": F.coalesce(_last(active, upto), F.lit(False)), "open_calls": F.sum(opened).over(upto)})
    here = F.struct(F.col("at_us").alias("t"), F.col("line_number").alias("line"))
    gone = F.struct(F.lit(None).cast("long").alias("t"), F.lit(None).cast(records.schema["line_number"].dataType).alias("line"))
    anchor = (
        F.when(F.col("what").isin("asked", "started"), here)
        .when(F.col("what").isin("call", "ended"), gone)
        .when(F.col("what") == "output", F.when(F.col("active") & (F.col("open_calls") == 0), here).otherwise(gone))
        .when(F.col("what") == "said", F.when(F.col("active"), here).otherwise(gone))
    )
    waiting = F.when((F.col("what") == "said") & F.coalesce(final, F.lit(False)) | (F.col("what") == "ended") & (F.col("payload.type") == "task_complete"), here).when(F.col("what").isin("asked", "call", "said", "ended"), gone)
    return rows.withColumns({"anchor_from": _last(anchor, before), "waiting_from": _last(waiting, before), "was_active": F.coalesce(F.lag("active").over(w), F.lit(False)), "were_open": F.coalesce(F.lag("open_calls").over(w), F.lit(0))})


def events(records: DataFrame, with_file: bool = False) -> DataFrame:
    """session_id, line_number, kind, name, start_us, end_us, timing, status, turn_id.

    Kinds: user, assistant, tool (a call until its output; open without one), user_wait
    (a blocking request, and from a task's end to the next prompt), llm (estimated: from
    when the model has the word to its next record) and event.
    """
    return _made(records).select(*["file"][: int(with_file)], "session_id", "line_number", "turn_id", *_EVENT)


_EVENT = ("kind", "name", "start_us", "end_us", "timing", "status")


def _made(records: DataFrame) -> DataFrame:
    """Events with the lines that what they show is from."""
    rows = marked(records).where("what IS NOT NULL AND session_id IS NOT NULL")
    rows = rows.withColumns({"anchor": F.col("anchor_from.t"), "anchor_line": F.col("anchor_from.line"), "waiting": F.col("waiting_from.t"), "waiting_line": F.col("waiting_from.line")})
    # fields of structs are taken out first: Catalyst loses columns where a generator reads them and its rows are filtered
    inner = {"tool": "payload.name", "said_type": "payload.type", "next_what": "next.what", "next_line": "next.line_number", "next_at": "next.at_us", "next_output": "next.output"}
    rows = rows.withColumns({k: F.col(v) for k, v in inner.items()}).withColumn("alone", F.col("next").isNull()).drop("payload", "next", "anchor_from", "waiting_from")
    none = F.lit(None).cast("long")

    def made(cond, kind, name, start, end, timing, status):
        return F.when(cond, F.struct(kind.alias("kind"), name.alias("name"), start.alias("start_us"), end.alias("end_us"), timing.alias("timing"), status.alias("status")))

    at, what, ok = F.col("at_us"), F.col("what"), F.lit("ok")
    lit = F.lit
    closed = F.col("next_what") == "output"
    failed = F.col("next_output").rlike(r"(?i)(?:exit(?:ed with)? code|Process exited with code)\s*[:=]?\s*[1-9]")
    call_kind = F.when(F.element_at(F.split("tool", "\\."), -1) == "request_user_input", "user_wait").otherwise("tool")
    gap = what.isin("call", "said") & F.col("was_active") & (F.col("were_open") == 0) & F.col("anchor").isNotNull() & (at > F.col("anchor"))
    out = F.array_compact(F.array(
        made(gap, lit("llm"), lit("LLM response (estimated)"), F.col("anchor"), at, lit("estimated"), ok),
        made((what == "asked") & F.col("waiting").isNotNull() & (at > F.col("waiting")), lit("user_wait"), lit("Between turns (inferred user wait)"), F.col("waiting"), at, lit("estimated"), ok),
        made(what == "asked", lit("user"), lit("User input"), at, none, lit("unknown"), ok),
        made(what == "said", lit("assistant"), lit("Assistant"), at, none, lit("unknown"), ok),
        made((what == "call") & closed, call_kind, F.col("tool"), at, F.greatest(at, F.col("next_at")), lit("estimated"), F.when(failed, "error").otherwise("ok")),
        made((what == "call") & F.col("alone"), call_kind, F.col("tool"), at, none, lit("unknown"), lit("incomplete")),
        made((what == "output") & (F.coalesce(F.col("former"), lit("")) != "call"), lit("event"), lit("Unmatched tool output"), at, none, lit("unknown"), lit("incomplete")),
        made(what == "ended", lit("event"), F.col("said_type"), at, none, lit("unknown"), F.when(F.col("said_type") == "task_complete", "ok").otherwise("interrupted")),
    ))
    begun = F.when(F.col("kind") == "llm", F.col("anchor_line")).when((F.col("kind") == "user_wait") & (F.col("what") == "asked"), F.col("waiting_line"))
    result = F.when((F.col("what") == "call") & closed, F.col("next_line"))
    rows = rows.select("*", F.inline(out)).withColumns({"begun_line": begun, "result_line": result})
    return rows.select("file", "session_id", "line_number", "turn_id", "what", "session_line", "turn_line", "begun_line", "result_line", *_EVENT)


#: How a field came about: taken over, worked out from values, or a rule's reading of them (fixed values).
NORMALIZED, CALCULATED, INFERRED = "normalized", "calculated", "inferred"


def evidence(records: DataFrame) -> DataFrame:
    """file, session_id, line_number, kind, pointer, origin, sources: of each event's fields, the lines and the places in them that it is from.

    A source is (line, pointer, use). Intervals that a rule infers have the lines they
    begin and end at, a closed call those of its result, a turn and a session the line
    that set them; a field without sources is the default of no record.
    """
    at = F.col("line_number")

    def source(line, pointer, use):
        return F.when(line.isNotNull(), F.struct(line.cast("long").alias("line"), F.lit(pointer).alias("pointer"), F.lit(use).alias("use")))

    def field(pointer, origin, *sources):
        origin = F.lit(origin) if isinstance(origin, str) else origin
        return F.struct(F.lit(pointer).alias("pointer"), origin.alias("origin"), F.array_compact(F.array(*sources)).alias("sources"))

    call, inferred = F.col("what") == "call", F.col("begun_line").isNotNull()
    closed = call & ~inferred & F.col("result_line").isNotNull()
    tool = call & ~inferred
    only = lambda cond, x: F.when(cond, x)
    begun, result = F.col("begun_line"), F.when(closed, F.col("result_line"))
    rule = (source(at, "/type", "classification"), source(at, "/payload/type", "classification"))
    bounds = (source(begun, "/timestamp", "interval_start"), only(inferred, source(at, "/timestamp", "interval_end")))
    fields = F.array(
        field("/session_id", NORMALIZED, source(F.col("session_line"), "/payload/id", "value")),
        field("/line_number", CALCULATED, source(at, "", "physical_line")),
        field("/turn_id", F.when(F.col("turn_line").isNull(), INFERRED).otherwise(NORMALIZED), source(F.col("turn_line"), "/payload/turn_id", "context")),
        field("/kind", INFERRED, *rule, only(tool, source(at, "/payload/name", "classification")), only(F.col("what").isin("asked", "said"), source(at, "/payload/role", "classification")), *bounds),
        field("/name", F.when(tool, NORMALIZED).otherwise(INFERRED), only(tool, source(at, "/payload/name", "value")), *[only(~tool, x) for x in rule]),
        field("/start_us", NORMALIZED, only(inferred, source(begun, "/timestamp", "interval_start")), only(~inferred, source(at, "/timestamp", "value"))),
        field("/end_us", F.when(closed, CALCULATED).when(inferred, NORMALIZED).otherwise(INFERRED), only(inferred, source(at, "/timestamp", "interval_end")), only(closed, source(at, "/timestamp", "value")), source(result, "/timestamp", "result")),
        field("/timing", INFERRED, *bounds, only(closed, source(at, "/payload/call_id", "pairing")), source(result, "/payload/call_id", "pairing")),
        field("/status", INFERRED, source(result, "/payload/output", "value"), only(tool & ~closed | (F.col("what") == "output"), source(at, "/payload/call_id", "pairing")), only(F.col("what") == "ended", source(at, "/payload/type", "classification"))),
    )
    return _made(records).select("file", "session_id", "line_number", "kind", F.inline(fields))


def without_mirrors(prompts: DataFrame) -> DataFrame:
    """Prompts less the event copies of what a response item says (columns session_id, task, line_number, source, text).

    Within a task, an event's text is a copy if the latest response item before it has
    the same text, or if the next prompt is a response item with the same text.
    """
    w = Window.partitionBy("session_id", "task").orderBy("line_number")
    item = F.when(F.col("source") == "response_item", F.col("text"))
    seen = F.last(item, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    following = F.lead(F.struct("source", "text")).over(w)
    rows = prompts.withColumns({"seen": seen, "following": following})
    copy = (F.col("source") == "event_msg") & (F.col("text").eqNullSafe(F.col("seen")) | ((F.col("following.source") == "response_item") & F.col("text").eqNullSafe(F.col("following.text"))))
    return rows.where(~F.coalesce(copy, F.lit(False))).drop("seen", "following")
