"""Scan results against the rules, one by one."""

import json

from loomtrace.operators import scans

TEXT = "Ann met Ann Lee in Rome."


def result(*findings, chunk="c1", review=False, **more):
    return json.dumps({"chunk_id": chunk, "requires_review": review, "findings": list(findings), **more})


def finding(start, end, quote=None, category="name", **more):
    return {"start": start, "end": end, "quote": TEXT[start:end] if quote is None else quote, "category": category, **more}


def test_each_rule(spark):
    cases = {
        result(): None, result(finding(0, 3), finding(8, 15)): None, "[]": 0, "null": 0, "{": 0, json.dumps({"chunk_id": "c1", "findings": []}): 0, result(extra=1): 0, result(chunk="c2"): 1, result(review=1): 1, result(review="false"): 1,
        json.dumps({"chunk_id": "c1", "requires_review": False, "findings": {}}): 2, result(1): 3, result(finding(0, 3, more=1)): 3, result({"start": 0}): 3, result(finding(0, 0)): 4, result(finding(-1, 2)): 4, result(finding(0, 25, "x")): 4,
        result(finding(0, 3) | {"start": 0.5}): 4, result(finding(0, 3) | {"end": "3"}): 4, result(finding(0, 3, "Bob")): 5, result(finding(0, 3) | {"quote": 7}): 5, result(finding(0, 3, category="odd")): 6, result(finding(0, 3) | {"category": None}): 6,
        result(finding(0, 3, category="odd"), finding(0, 99, "x")): 4,
    }
    for n, (body, want) in enumerate(cases.items()):
        cases[body] = (f"c{n}", want)
    rows = [(i, body.replace('"chunk_id": "c1"', f'"chunk_id": "{i}"')) for body, (i, _) in cases.items()]
    chunks = spark.createDataFrame([("m", i, 0, TEXT) for i, _ in rows], "message string, chunk_id string, start int, text string")
    got = {r.chunk_id: r.reason for r in scans.validated(spark.createDataFrame(rows, "chunk_id string, body string"), chunks, ("name", "place")).collect()}
    assert got == {i: None if want is None else scans.REASONS[want] for i, want in cases.values()}


def test_messages(spark):
    chunks, results = [], []

    def message(name, *parts):
        """Parts: begin and end of a chunk, and its findings in the message; None for no result."""
        for a, b, found in parts:
            i = f"{name}{a}"
            chunks.append((name, i, a, TEXT[a:b]))
            if found is not None:
                results.append((i, result(*[finding(x - a, y - a, TEXT[x:y], c) for x, y, c in found], chunk=i, review=name == "twice")))

    message("twice", (0, 15, [(8, 15, "name")]), (8, 24, [(8, 15, "name"), (19, 23, "place")]))
    message("part", (0, 15, [(8, 15, "name")]), (12, 24, [(12, 15, "name")]))
    message("other", (0, 15, [(8, 15, "name")]), (12, 24, [(12, 15, "place")]))
    message("over", (0, 12, [(8, 12, "name")]), (10, 24, [(10, 15, "name")]))
    message("inside", (0, 24, [(8, 15, "name"), (8, 11, "name")]))
    message("lost", (0, 15, []), (12, 24, None))
    message("none", (0, 24, []))
    results.append(("none0", result(finding(0, 3), chunk="none0")))
    checked = scans.validated(spark.createDataFrame(results + results[:1], "chunk_id string, body string"), df := spark.createDataFrame(chunks, "message string, chunk_id string, start int, text string"), ("name", "place"))
    messages, found = scans.merged(checked, df)
    assert {r.message: (r.reason, r.review) for r in messages.collect()} == {
        "twice": (None, True), "part": (None, False), "other": ("findings conflict", False), "over": ("findings conflict", False), "inside": ("findings conflict", False), "lost": ("a chunk has no result", False), "none": ("several results", False),
    }
    assert sorted(tuple(r) for r in found.collect()) == [("part", 8, 15, "Ann Lee", "name"), ("twice", 8, 15, "Ann Lee", "name"), ("twice", 19, 23, "Rome", "place")]
