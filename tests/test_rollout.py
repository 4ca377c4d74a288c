"""Rollout records to events on a session written out here."""

import json

from pyspark.sql import functions as F

from loomtrace.operators import lineage, rollout
from loomtrace.sources import rollout as source


def line(second, kind, **payload):
    return json.dumps({"timestamp": f"2026-01-01T00:{second // 60:02d}:{second % 60:02d}Z", "type": kind, "payload": payload})


def test_events_of_a_session(spark):
    lines = [
        line(0, "session_meta", id="s1"), "", line(1, "event_msg", type="task_started", turn_id="t1"), line(2, "response_item", type="message", role="user", text="go"),
        line(5, "response_item", type="function_call", call_id="a", name="shell"), line(6, "response_item", type="function_call", call_id="b", name="x.request_user_input"),
        line(9, "response_item", type="function_call_output", call_id="a", output="exited with code 3"), line(12, "response_item", type="function_call_output", call_id="b", output="yes"),
        line(12, "response_item", type="function_call_output", call_id="zz", output="?"), line(20, "response_item", type="message", role="assistant", phase="final_answer", text="done"),
        line(21, "event_msg", type="task_complete", turn_id="t1"), line(51, "response_item", type="message", role="user", text="more"), line(52, "response_item", type="function_call", call_id="c", name="shell"),
    ]
    files = spark.createDataFrame([("f", "\n".join(lines) + "\n"), ("bad", line(0, "session_meta", id="s2") + "\n{")], "file string, value string")
    got = rollout.events(source.records(source.lines_of(files))).orderBy("line_number", "kind").collect()
    assert {r.session_id for r in got} == {"s1"}  # one bad line rejects its file
    base = 1_767_225_600_000_000
    rows = [(r.line_number, r.kind, (r.start_us - base) // 10**6, None if r.end_us is None else (r.end_us - base) // 10**6, r.status) for r in got]
    assert rows == [
        (4, "user", 2, None, "ok"), (5, "llm", 2, 5, "ok"), (5, "tool", 5, 9, "error"), (6, "user_wait", 6, 12, "ok"), (9, "event", 12, None, "incomplete"), (10, "assistant", 20, None, "ok"), (10, "llm", 12, 20, "ok"),
        (11, "event", 21, None, "ok"), (12, "user", 51, None, "ok"), (12, "user_wait", 21, 51, "ok"), (13, "llm", 51, 52, "ok"), (13, "tool", 52, None, "incomplete"),
    ]
    assert {r.line_number: r.turn_id for r in got}[5] == "t1"


def test_physical_lines_are_counted(spark):
    got = source.lines_of(spark.createDataFrame([("f", "a\r\n\nb"), ("g", "x\n")], "file string, value string")).collect()
    assert sorted((r.file, r.line_number, r.line) for r in got) == [("f", 1, "a"), ("f", 2, ""), ("f", 3, "b"), ("g", 1, "x")]


def test_mirrored_prompts(spark):
    rows = [(1, 1, "event_msg", "a"), (1, 2, "response_item", "a"), (1, 3, "event_msg", "a"), (1, 4, "event_msg", "b"), (1, 5, "response_item", "c"), (2, 6, "event_msg", "a"), (2, 7, "event_msg", "d"), (2, 8, "response_item", "d")]
    df = spark.createDataFrame([("s", *r) for r in rows], "session_id string, task int, line_number int, source string, text string")
    assert sorted(r.line_number for r in rollout.without_mirrors(df).collect()) == [2, 4, 5, 6, 8]


def test_what_is_no_sound_record_rejects_its_file(spark):
    head = line(0, "session_meta", id="s")
    tails = [
        "{", '{"type":"response_item"}', "null", "[]", '{"payload":null}', head + "{", head + "," + head, head + "} {}", '{"timestamp":"2026-01-01T00:00:00","type":"x","payload":{}}', '{"timestamp":"2026-01-01T00:00:00-00:00","type":"x"}',
        '{"timestamp":"1969-12-31T23:59:59Z","type":"x"}', '{"timestamp":5,"type":"x"}', '{"timestamp":"2026-01-01T00:00:00Z","type":"x","payload":[]}',
    ]
    good = ['{"timestamp":"2026-01-01T00:00:00Z","type":"x"}', head + "  ", '{"timestamp":"2026-01-01t00:00:00.5+01:00","type":"x","payload":{}}']
    rows = [(f"bad{k}", head + "\n" + t) for k, t in enumerate(tails)] + [(f"good{k}", head + "\n" + t) for k, t in enumerate(good)]
    got = source.records(source.lines_of(spark.createDataFrame(rows, "file string, value string"))).collect()
    assert {r.file for r in got} == {f"good{k}" for k in range(len(good))} and len(got) == 2 * len(good)


def test_an_edited_line_breaks_the_evidence_that_rests_on_it(spark):
    lines = [
        line(0, "session_meta", id="s"), line(1, "event_msg", type="task_started", turn_id="t1"), line(2, "response_item", type="function_call", call_id="a", name="shell"), line(4, "response_item", type="function_call_output", call_id="a", output="ok"),
        line(6, "response_item", type="message", role="assistant", phase="final_answer", text="x"),
    ]
    held = source.lines_of(spark.createDataFrame([("f", "\n".join(lines))], "file string, value string"))
    saved = lineage.saved(rollout.evidence(source.records(held)), held)
    archives = held.select("file").distinct()
    assert {r.state for r in lineage.checked(saved, held, archives).collect()} == {"ok", "no source"}

    def broken(lines_now, archives=archives):
        return {(r.kind, r.field, r.line, r.state) for r in lineage.checked(saved, lines_now, archives).collect() if r.state not in ("ok", "no source")}

    later = held.withColumn("line", F.when(F.col("line_number") == 4, F.lit(line(5, "response_item", type="function_call_output", call_id="a", output="ok"))).otherwise(F.col("line")))
    assert broken(later) == {("tool", "/end_us", 4, "changed"), ("llm", "/start_us", 4, "changed"), ("llm", "/kind", 4, "changed"), ("llm", "/timing", 4, "changed")} | {x for x in broken(later) if x[1] == "/line_number"}
    gone = held.where("line_number != 2")
    assert {x[1:] for x in broken(gone)} >= {("/turn_id", 2, "no line")} and all(x[3] == "no line" for x in broken(gone))
    less = held.withColumn("line", F.when(F.col("line_number") == 2, F.lit(line(1, "event_msg", type="task_started"))).otherwise(F.col("line")))
    assert ("tool", "/turn_id", 2, "unresolved") in broken(less)
    assert {x[3] for x in broken(held, archives.where("false"))} == {"no archive"}
