"""Spans and replacement against Python's re."""

import re

from pyspark.sql import functions as F

from loomtrace.operators import privacy

TEXTS = ["mail a.b@c.de or 12345 at x.y.org. Call 0123 4567é 99", "", "no finds here", "éé 1234é a@b.co;c@d.eu", "8.8.8.8 and 20240101@h.io"]


def expected(text):
    found = [(m.start(), m.end(), c) for c, p in privacy.DETECTORS for m in re.finditer(p, text)]
    kept = []
    for s in sorted(found, key=lambda s: (s[0], -s[1], s[2])):
        if not kept or kept[-1][1] < s[1]:
            kept.append(s)
    return kept


def test_spans_and_replacement(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    df = df.withColumn("spans", privacy.outermost(privacy.findings(F.col("text")))).withColumn("clean", privacy.replaced(F.col("text"), F.col("spans")))
    for r in df.collect():
        want = expected(r.text)
        assert [tuple(s) for s in r.spans] == want
        clean = r.text
        for a, b, c in reversed(want):
            clean = clean[:a] + f"[{c.upper()}]" + clean[b:]
        assert r.clean == clean
