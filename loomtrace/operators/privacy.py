"""Findings in text as character spans: detection, merging, replacement."""

from __future__ import annotations

from pyspark.sql import functions as F

#: Category and pattern of the deterministic detector (fixed values).
DETECTORS = [("email", r"[A-Za-z0-9._]+@[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)+"), ("host", r"[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)+"), ("number", r"\d{4,}")]
SPAN = "array<struct<start:int,end:int,category:string>>"


def findings(text):
    """Spans (start, end, category) of every detector's matches, by (start, end descending, category).

    A match begins after the pieces and matches before it.
    """
    def upto(parts, n):
        return F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))

    def spans(category: str, pattern: str):
        pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        start = lambda i: upto(pieces, i + 1) + upto(matches, i)
        return F.transform(matches, lambda m, i: F.struct(start(i).alias("start"), (start(i) + F.length(m)).alias("end"), F.lit(category).alias("category")))

    found = [spans(c, p) for c, p in DETECTORS]
    return F.array_sort(F.concat(*found), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).otherwise(F.when(a["category"] < b["category"], -1).when(a["category"] > b["category"], 1).otherwise(0)))


def outermost(spans):
    """Less the spans that lie within an earlier one."""
    step = lambda kept, s: F.when((F.size(kept) > 0) & (F.get(kept, F.size(kept) - 1)["end"] >= s["end"]), kept).otherwise(F.concat(kept, F.array(s)))
    return F.aggregate(spans, F.array().cast(SPAN), step)


def replaced(text, spans):
    """Spans replaced by their category in brackets, from the last to the first so that places before stay true."""
    put = lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.lit("["), F.upper(s["category"]), F.lit("]"), F.substr(t, s["end"] + 1))
    return F.aggregate(F.reverse(spans), text, put)
