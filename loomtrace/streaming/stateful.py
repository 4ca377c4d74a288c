"""Keyed state over streams: rollouts that arrive in pieces, and spans whose sessions late evidence revises.

Both keep a key's state in Spark's state store, so a query goes on from its
checkpoint, and any cutting of the input into batches gives the rows that the batch
operators give over all of it. State stores need RocksDB, which ``prepared`` sets.

Rollout lines are taken in order of their number; lines that come early wait in the
state. What is known is emitted at once: a tool call when its output comes, or when
its file ends. A file ends with a row marked ``last``, or after ``idle_ms`` without
lines, by a timer; lines that come after that reopen nothing. A record that isn't
sound revokes its file: one row says so, and its events are to be dropped.

A trace's spans are attributed anew whenever one comes, and what changed is emitted:
``new``, ``corrected`` (another session), or ``revoked`` (an inference that evidence
has made ambiguous). A trace lies in one task, as its ancestors may be any of its spans.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomtrace.operators.rollout import CALLS, OUTPUTS
from loomtrace.sources.rollout import decoded

EVENTS = "session_id string, line_number long, turn_id string, kind string, name string, start_us long, end_us long, timing string, status string"
ROLLOUT_OUT = f"change string, file string, {EVENTS}"
SPANS_OUT = "change string, trace_id string, span_id string, session_id string, basis string"
_ROLLOUT_NAMES = [x.split()[0] for x in ROLLOUT_OUT.split(", ")]
_SPAN_NAMES = [x.split()[0] for x in SPANS_OUT.split(", ")]
#: State as JSON text by a text or a number; workers have no session to read a schema with.
_TEXT, _NUMBER = T.StructType([T.StructField("x", T.StringType())]), T.StructType([T.StructField("x", T.LongType())])
_FIELDS = ("at_us", "type", "kind", "role", "phase", "id", "turn_id", "call_id", "name", "failed", "sound")


def prepared(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Rollout:
    """What a reader of one rollout remembers (``state``, plain values), and the events that a record adds."""

    def __init__(self, state: dict | None = None):
        self.state = state or {"next": 1, "session": None, "turn": None, "active": False, "calls": {}, "anchor": None, "waiting": None, "over": False}

    def _event(self, line: int, turn, kind: str, name, start: int, end, timing: str, status: str) -> tuple:
        return (self.state["session"], line, turn, kind, name, start, end, timing, status)

    def _call(self, call: dict, end, failed) -> tuple:
        kind = "user_wait" if (call["name"] or "").split(".")[-1] == "request_user_input" else "tool"
        status = "incomplete" if end is None else "error" if failed else "ok"
        return self._event(call["line"], call["turn"], kind, call["name"], call["at"], end, "unknown" if end is None else "estimated", status)

    def record(self, line: int, r: dict) -> list[tuple]:
        s, out, at = self.state, [], r["at_us"]
        if r["type"] == "session_meta":
            s["session"] = s["session"] or r["id"]
        item, kind = r["type"] == "response_item", r["kind"]
        said = item and kind in ("message", "reasoning") and r["role"] not in ("developer", "system", "user")
        said = said or item and kind == "reasoning" and r["role"] == "user"
        asked, call, output = item and kind == "message" and r["role"] == "user", item and kind in CALLS, item and kind in OUTPUTS
        started, ended = r["type"] == "event_msg" and kind == "task_started", r["type"] == "event_msg" and kind in ("task_complete", "turn_aborted")
        if (r["type"] == "turn_context" or started) and r["turn_id"] is not None:
            s["turn"] = r["turn_id"]
        add = lambda *x: out.append(self._event(line, s["turn"], *x)) if s["session"] is not None else None
        if (call or said) and s["active"] and not s["calls"] and s["anchor"] is not None and at > s["anchor"]:
            add("llm", "LLM response (estimated)", s["anchor"], at, "estimated", "ok")
        if asked:
            if s["waiting"] is not None and at > s["waiting"]:
                add("user_wait", "Between turns (inferred user wait)", s["waiting"], at, "estimated", "ok")
            add("user", "User input", at, None, "unknown", "ok")
        if said:
            add("assistant", "Assistant", at, None, "unknown", "ok")
        if ended:
            add("event", kind, at, None, "unknown", "ok" if kind == "task_complete" else "interrupted")
        key = json.dumps(r["call_id"])
        if call:
            s["calls"][key] = {"line": line, "turn": s["turn"], "name": r["name"], "at": at, "known": s["session"] is not None}
        if output:
            paired = s["calls"].pop(key, None)
            if paired is None:
                add("event", "Unmatched tool output", at, None, "unknown", "incomplete")
            elif paired["known"]:
                out.append(self._call(paired, max(at, paired["at"]), r["failed"]))
        final = said and r["phase"] == "final_answer"
        if asked or started:
            s["active"] = True
        elif ended or final:
            s["active"] = False
        if asked or started:
            s["anchor"] = at
        elif call or ended:
            s["anchor"] = None
        elif output:
            s["anchor"] = at if s["active"] and not s["calls"] else None
        elif said:
            s["anchor"] = at if s["active"] else None
        if final or ended and kind == "task_complete":
            s["waiting"] = at
        elif asked or call or said or ended:
            s["waiting"] = None
        return out

    def end(self) -> list[tuple]:
        """Calls that no output came for."""
        out = [self._call(c, None, False) for c in self.state["calls"].values() if c["known"]]
        self.state["calls"], self.state["over"] = {}, True
        return out


class RolloutProcessor(StatefulProcessor):
    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reader = handle.getValueState("reader", _TEXT)
        self.early = handle.getMapState("early", _NUMBER, _TEXT)

    def _read(self) -> Rollout:
        return Rollout(json.loads(self.reader.get()[0]) if self.reader.exists() else None)

    def _out(self, file: str, rows: list[tuple], change: str = "event") -> pd.DataFrame:
        return pd.DataFrame([(change, file, *r) for r in rows], columns=_ROLLOUT_NAMES).astype({"line_number": "Int64", "start_us": "Int64", "end_us": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        reader, found = self._read(), []
        if reader.state["over"]:
            return
        for part in rows:
            for r in part.to_dict("records"):
                record = {k: None if pd.isna(r[k]) else r[k] for k in _FIELDS} | {"last": bool(r["last"]), "blank": bool(r["blank"])}
                if record["at_us"] is not None:
                    record["at_us"] = int(record["at_us"])
                self.early.updateValue((int(r["line_number"]),), (json.dumps(record, default=bool),))
        while self.early.containsKey((reader.state["next"],)):
            at = (reader.state["next"],)
            record = json.loads(self.early.getValue(at)[0])
            self.early.removeKey(at)
            reader.state["next"] += 1
            if not record["blank"]:
                if not record["sound"]:
                    reader.state["over"] = True
                    yield self._out(key[0], [(None,) * 9], "revoked")
                    break
                found += reader.record(at[0], record)
            if record["last"]:
                found += reader.end()
                break
        if self.idle_ms is not None:
            if reader.state.get("timer"):
                self.handle.deleteTimer(reader.state["timer"])
            reader.state["timer"] = None if reader.state["over"] else timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            if reader.state["timer"]:
                self.handle.registerTimer(reader.state["timer"])
        self.reader.update((json.dumps(reader.state),))
        if found:
            yield self._out(key[0], found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reader = self._read()
        found = reader.end()
        self.reader.update((json.dumps(reader.state),))
        if found:
            yield self._out(key[0], found)

    def close(self) -> None:
        pass


def rollout_events(lines: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Stream of lines (file, line_number, line, last) to change (event or revoked), file and the columns of an event."""
    blank = F.coalesce(F.trim("line") == "", F.lit(True))
    failed = F.col("payload.output").rlike(r"(?i)(?:exit(?:ed with)? code|Process exited with code)\s*[:=]?\s*[1-9]")
    # a blank line is decoded as an empty record, to keep its number
    kept = lines.withColumns({"blank": blank, "line": F.when(blank, "{}").otherwise(F.col("line"))})
    rows = decoded(kept).select("file", F.col("line_number").cast("long").alias("line_number"), F.coalesce("last", F.lit(False)).alias("last"), "blank", "at_us", "type", F.col("payload.type").alias("kind"), *[f"payload.{c}" for c in ("role", "phase", "id", "turn_id", "call_id", "name")], F.coalesce(failed, F.lit(False)).alias("failed"), "sound")
    mode = "processingTime" if idle_ms is not None else "none"
    return rows.groupBy("file").transformWithStateInPandas(statefulProcessor=RolloutProcessor(idle_ms), outputStructType=ROLLOUT_OUT, outputMode="Append", timeMode=mode)


def attributions(trace: str, spans: dict[str, dict]) -> dict[str, tuple[str, str]]:
    """session_id and basis of each span of a trace, by the rules of ``traces.attributed``."""
    nearest: dict[str, str | None] = {}
    for start in spans:
        path, at = [], start
        while at in spans and at not in nearest and at not in path:
            path.append(at)
            if spans[at]["direct"] is not None:
                break
            at = spans[at]["parent"]
        found = spans[at]["direct"] if at in spans and spans[at]["direct"] is not None else nearest.get(at)
        nearest.update((x, found) for x in path if x not in nearest)
    candidates = {c for s in spans.values() for c in s["candidates"]}
    out = {}
    for i, s in spans.items():
        if s["direct"] is not None:
            out[i] = (s["direct"], s["basis"])
        elif nearest[i] is not None:
            out[i] = (nearest[i], "ancestor span conversation identity")
        elif len(candidates) == 1:
            out[i] = (next(iter(candidates)), "unique conversation identity in trace")
        else:
            out[i] = (trace, "unattributed trace")
    return out


class SpanProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spans = handle.getMapState("spans", _TEXT, _TEXT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: json.loads(v[0]) for k, v in self.spans.iterator()}
        for part in rows:
            for r in part.itertuples():
                new = {"parent": r.parent_span_id, "direct": r.direct, "basis": r.basis, "candidates": list(r.candidates) if r.candidates is not None else [], "said": None}
                before = held.get(r.span_id)
                # of repeated spans the least stands for all, whatever order they come in
                if before is None or json.dumps([new["direct"] is None, new["direct"], new["parent"]]) < json.dumps([before["direct"] is None, before["direct"], before["parent"]]):
                    new["said"] = before and before["said"]
                    new["candidates"] = sorted({*new["candidates"], *(before["candidates"] if before else ())})
                    held[r.span_id] = new
                else:
                    before["candidates"] = sorted({*before["candidates"], *new["candidates"]})
        out = []
        for i, now in attributions(key[0], held).items():
            said = held[i]["said"]
            if said != list(now):
                change = "new" if said is None else "revoked" if now[1] == "unattributed trace" else "corrected"
                out.append((change, key[0], i, *now))
                held[i]["said"] = list(now)
            self.spans.updateValue((i,), (json.dumps(held[i]),))
        if out:
            yield pd.DataFrame(out, columns=_SPAN_NAMES)

    def close(self) -> None:
        pass


def span_sessions(spans: DataFrame) -> DataFrame:
    """Stream of spans (trace_id, span_id, parent_span_id, direct, basis, candidates) to what changes of their sessions."""
    rows = spans.select("trace_id", "span_id", "parent_span_id", "direct", "basis", "candidates")
    return rows.groupBy("trace_id").transformWithStateInPandas(statefulProcessor=SpanProcessor(), outputStructType=SPANS_OUT, outputMode="Append", timeMode="none")
