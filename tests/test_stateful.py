"""Streams with keyed state against the batch operators over the whole input."""

import json
import random
import time

import pytest

from loomtrace.operators import rollout, traces
from loomtrace.sources import rollout as source
from loomtrace.streaming import stateful

LINES = "file string, line_number long, line string, last boolean"
SPANS = "trace_id string, span_id string, parent_span_id string, direct string, basis string, candidates array<string>"


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.prepared(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(spark, tmp_path, schema, operator, batches, restart_at=None):
    """Each batch is a file; the query is stopped and started again before ``restart_at``."""
    (tmp_path / "in").mkdir()
    rows = []
    stream = lambda: operator(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in"))

    def go():
        q = stream().writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/state").foreachBatch(lambda df, _: rows.extend(df.collect())).start()
        q.awaitTermination()

    for k, batch in enumerate(batches):
        if k == restart_at:
            go()
        (tmp_path / "in" / f"{k:03d}.json").write_text("\n".join(json.dumps(r) for r in batch))
    go()
    return rows


def _line(second, kind, **payload):
    return json.dumps({"timestamp": f"2026-01-01T00:{second // 60:02d}:{second % 60:02d}Z", "type": kind, "payload": payload})


def session(name, seed):
    r = random.Random(seed)
    out, at = [_line(0, "session_meta", id=name), ""], 1
    for k in range(40):
        at += r.randrange(0, 4)
        out.append(r.choice([
            lambda: _line(at, "event_msg", type="task_started", turn_id=f"t{k}"), lambda: _line(at, "response_item", type="message", role="user", text="x"),
            lambda: _line(at, "response_item", type="function_call", call_id=f"c{r.randrange(4)}", name=r.choice(["shell", "a.request_user_input"])),
            lambda: _line(at, "response_item", type="function_call_output", call_id=f"c{r.randrange(4)}", output=r.choice(["ok", "exited with code 3"])),
            lambda: _line(at, "response_item", type="message", role="assistant", phase=r.choice([None, "final_answer"]), text="y"), lambda: _line(at, "response_item", type="reasoning"),
            lambda: _line(at, "event_msg", type=r.choice(["task_complete", "turn_aborted"])), lambda: _line(at, "response_item", type="message", role="developer", text="z"), lambda: "  ",
        ])())
    return out


def test_rollouts_in_pieces(spark, tmp_path):
    files = {f"f{k}": session(f"s{k}", k) for k in range(6)} | {"bad": [*session("b", 9)[:20], "{", *session("b", 9)[20:]]}
    rows = [{"file": f, "line_number": n + 1, "line": x, "last": n + 1 == len(lines)} for f, lines in files.items() for n, x in enumerate(lines)]
    batch = rollout.events(source.records(spark.createDataFrame([tuple(r.values()) for r in rows], LINES)))
    want = sorted((tuple(r) for r in batch.collect()), key=str)
    random.Random(1).shuffle(rows)
    got = run(spark, tmp_path, LINES, stateful.rollout_events, [rows[:40], rows[40:41], rows[41:150], rows[150:]], restart_at=2)
    revoked = {r.file for r in got if r.change == "revoked"}
    assert revoked == {"bad"} and len(want) > 100
    assert sorted((tuple(r)[2:] for r in got if r.change == "event" and r.file not in revoked), key=str) == want


def test_idle_files_end_by_a_timer(spark, tmp_path):
    lines = session("s", 1)[:2] + [_line(3, "response_item", type="function_call", call_id="a", name="shell")]
    rows = [{"file": "f", "line_number": n + 1, "line": x, "last": False} for n, x in enumerate(lines)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps(r) for r in rows))
    got, stream = [], spark.readStream.schema(LINES).json(f"file://{tmp_path}/in")
    # a trigger that goes on, as the timer is due when all input is read
    q = stateful.rollout_events(stream, idle_ms=1).writeStream.outputMode("append").option("checkpointLocation", f"file://{tmp_path}/state").foreachBatch(lambda df, _: got.extend(df.collect())).start()
    until = time.time() + 120
    while not got and time.time() < until and q.isActive:
        time.sleep(0.5)
    q.stop()
    assert [(r.file, r.kind, r.status) for r in got] == [("f", "tool", "incomplete")]


def test_spans_of_late_evidence(spark, tmp_path):
    r = random.Random(4)
    rows = []
    for t in range(12):
        for k in range(9):
            own = r.choice([None, None, None, "a", "b" if t % 2 else "a"])
            rows.append({"trace_id": f"t{t}", "span_id": f"s{k}", "parent_span_id": r.choice([None, f"s{r.randrange(9)}"]), "direct": own, "basis": own and "session.id", "candidates": [own] if own else r.choice([[], ["c"]] if t == 3 else [[]])})
    want = {(x.trace_id, x.span_id): (x.session_id, x.basis) for x in traces.attributed(spark.createDataFrame([tuple(x.values()) for x in rows], SPANS)).collect()}
    r.shuffle(rows)
    got = run(spark, tmp_path, SPANS, stateful.span_sessions, [rows[:30], rows[30:70], rows[70:71], rows[71:]], restart_at=2)
    latest = {}
    for x in got:
        assert (x.change == "new") == ((x.trace_id, x.span_id) not in latest)
        latest[x.trace_id, x.span_id] = (x.session_id, x.basis)
    assert latest == want and {x.change for x in got} == {"new", "corrected", "revoked"}
