"""Exports in the binary form, and stored payloads read again."""

import gzip
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtrace.operators import otlp, reprocess, rollout, traces
from loomtrace.plans import reprocess_queries
from loomtrace.sources import rollout as source

VALUE = st.recursive(
    st.one_of(st.builds(lambda x: {"stringValue": x}, st.text(max_size=5)), st.builds(lambda x: {"intValue": str(x)}, st.integers(-(2**63), 2**63 - 1)), st.builds(lambda x: {"boolValue": x}, st.booleans()), st.builds(lambda x: {"doubleValue": x}, st.floats(allow_nan=False))),
    lambda inner: st.one_of(st.builds(lambda x: {"arrayValue": {"values": x}}, st.lists(inner, min_size=1, max_size=3)), st.builds(lambda x: {"kvlistValue": {"values": [{"key": "k", "value": v} for v in x]}}, st.lists(inner, min_size=1, max_size=3))), max_leaves=6,
)
SPAN = st.fixed_dictionaries({"traceId": st.just("0af7651916cd43dd8448eb211c80319c"), "spanId": st.just("b7ad6b7169203331"), "name": st.text(max_size=6), "startTimeUnixNano": st.integers(0, 2**64 - 1).map(str), "attributes": st.lists(st.builds(lambda v: {"key": "a", "value": v}, VALUE), min_size=1, max_size=3), "status": st.just({"code": 2})})


@settings(max_examples=60, deadline=None)
@given(st.lists(SPAN, min_size=1, max_size=3))
def test_bytes_and_back(spans):
    body = {"resourceSpans": [{"resource": {"attributes": [{"key": "é", "value": {"stringValue": ""}}]}, "scopeSpans": [{"scope": {"name": "s"}, "spans": spans}]}]}
    data = otlp.to_wire(body)
    assert otlp.message(memoryview(data)) == body
    # fields that aren't known are skipped, of any wire type
    assert otlp.message(memoryview(data + bytes([0xA0, 0x06, 0x96, 0x01, 0xA2, 0x06, 2, 1, 2, 0xA1, 0x06, *range(8), 0xA5, 0x06, *range(4)]))) == body
    for cut in range(1, min(len(data), 40)):
        try:
            shorter = otlp.message(memoryview(data[:-cut]))
        except ValueError:
            continue
        assert shorter == {}  # nothing is left


def test_both_forms_give_equal_rows_and_bad_ones_none(spark):
    span = {"traceId": "0AF7651916CD43DD8448EB211C80319C", "spanId": "b7ad6b7169203331", "name": "n", "startTimeUnixNano": "5", "attributes": [{"key": "k", "value": {"intValue": "-3"}}, {"key": "k", "value": {"boolValue": True}}]}
    body = {"resourceSpans": [{"scopeSpans": [{"spans": [span, span | {"spanId": "b7ad6b7169203332"}]}]}]}
    wire = otlp.to_wire(body)
    bad_id = json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span | {"spanId": "b7"}]}]}]}).encode()
    rows = [("json", "application/json", json.dumps(body).encode()), ("wire", otlp.BINARY, wire), ("cut", otlp.BINARY, wire[:-1]), ("tag", otlp.BINARY, b"\x07"), ("id", "application/json", bad_id), ("list", "application/json", b"[]"), ("null", "application/json", None), ("none", otlp.BINARY, b"")]
    decoded = otlp.decoded(spark.createDataFrame(rows, "capture_id string, content_type string, content binary"))
    assert {r.capture_id for r in decoded.collect() if r.error} == {"cut", "tag", "id", "list", "null"}
    by = {}
    for r in otlp.spans(decoded).orderBy("capture_id", "sequence").collect():
        by.setdefault(r.capture_id, []).append(tuple(r)[1:])
    assert by["json"] == by["wire"] and set(by) == {"json", "wire"} and [x[0] for x in by["wire"]] == [0, 1]
    assert by["wire"][0][1:3] == ("0af7651916cd43dd8448eb211c80319c", "b7ad6b7169203331") and by["wire"][0][-1] == {"k": "true"}


def test_key_value_lists_inside_others(spark):
    deep = {"key": "a", "value": {"kvlistValue": {"values": [{"key": "b", "value": {"kvlistValue": {"values": [{"key": "c", "value": {"intValue": "7"}}]}}}, {"key": "d", "value": {"stringValue": "x"}}]}}}
    df = spark.createDataFrame([(1, json.dumps([deep]))], "id int, attributes string")
    assert {(r.name, r.type, r.value) for r in traces.any_values(df, "id", "attributes").collect()} == {("a.b.c", "int", "7"), ("a.d", "string", "x")}


def _line(second, kind, **payload):
    return json.dumps({"timestamp": f"2026-01-01T00:00:{second:02d}Z", "type": kind, "payload": payload})


def test_stored_payloads_read_again(spark):
    text = "\n".join([_line(0, "session_meta", id="s"), _line(1, "event_msg", type="task_started", turn_id="t"), _line(2, "response_item", type="function_call", call_id="a", name="request_user_input"), _line(3, "response_item", type="function_call_output", call_id="a", output="ok")]).encode()
    rows = [
        ("same", "rollout", text, None), ("mended", "rollout", text, "gzip"), ("fresh", "rollout", text, "identity"), ("bad", "rollout", text + b"\n{", None), ("bomb", "rollout", b"x" * 5000, None), ("plain", "rollout", b"\n", None),
        ("odd", "metrics", text, None), ("null", "rollout", None, None), ("span", "otlp_traces", b"{}", None), ("broken", "otlp_traces", b"{", None),
    ]
    captures = spark.createDataFrame([(i, s, "application/json", gzip.compress(c) if e == "gzip" else c, e) for i, s, c, e in rows], "capture_id string, source string, content_type string, content binary, encoding string")
    lines = source.lines_of(spark.createDataFrame([(i, text.decode()) for i in ("same", "mended")], "file string, value string"))
    # the rule that was broken took requests for input as tools
    old = rollout.events(source.records(lines), with_file=True).withColumn("kind", F.when(F.col("file") == "mended", F.lit("tool")).otherwise(F.col("kind")))
    before = reprocess.digests(old, "file", reprocess.EVENT).select(F.col("file").alias("capture_id"), "digest")
    got = {r.capture_id: r for r in reprocess.reprocessed(captures, before, 4096).collect()}
    assert {i: r.change for i, r in got.items() if r.change} == {"same": "same", "mended": "changed", "fresh": "new", "span": "new"}
    assert {i: r.error for i, r in got.items() if r.error} == {
        "bad": "refused by its reader", "bomb": "not decoded within the limit", "odd": "no reader for the source", "null": "not decoded within the limit", "broken": "JSONDecodeError: refused", "plain": "refused by its reader",
    }
    assert got["same"].digest == got["fresh"].digest and (got["same"].n, got["span"].n) == (2, 0)


def test_spans_are_opened_without_a_shuffle(spark):
    """Places run on over an export's resources and scopes, whatever is missing there; each form is made of its own events."""
    span = lambda n: {"spanId": f"{n:016x}", "attributes": [{"key": "n", "value": {"intValue": str(n)}}]}
    at = {"attributes": [{"key": "r", "value": {"stringValue": "x"}}]}
    body = {"resourceSpans": [{"scopeSpans": [{"spans": [span(0), span(1)]}, {"scope": {"name": "s"}}, {"scope": {"name": "t"}, "spans": [span(2)]}]}, {"resource": at}, {"resource": at, "scopeSpans": [{"spans": []}, {"spans": [span(3)]}]}]}
    rows = [("a", json.dumps(body)), ("b", json.dumps({"resourceSpans": None})), ("c", "{}"), ("d", None), ("e", json.dumps(body | {"other": 1}))]
    df = otlp.spans(spark.createDataFrame(rows, "capture_id string, body string"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.capture_id, r.sequence, int(r.span_id, 16), r.scope_name, r.resource, r.record["n"]) for r in df.collect())
    assert got == [(i, n, n, "t" if n == 2 else None, {"r": "x"} if n == 3 else {}, str(n)) for i in "ae" for n in range(4)]
    plan = reprocess_queries.otlp_binary(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Window" not in plan
