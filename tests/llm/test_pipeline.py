"""The pipeline, stage by stage on the smallest tables, against brute force; and op4 against its SQL."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from loomtrace.llm import packing, toxicity, urls
from loomtrace.llm.shared import table, written
from tests.llm.test_dedup import brute
from tests.llm.test_filters import ALNUM, LOW, leaks
from tests.llm.test_near_copies import components, shingles
from tests.llm.test_tokens import ids_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents").withColumn("Score", F.lit("kept")), {}
    for name, stage in P.STAGES:
        new = written(stage(spark, docs, SF), name)
        out[name] = (docs, new)
        docs = new
    return out


def rows(df):
    return sorted(df.collect(), key=lambda r: r.doc_id)


def test_columns_stay(stages):
    for name in ("toxicity", "line_dedup", "simhash", "decontamination"):
        before, after = stages[name]
        assert after.columns == before.columns and {r.Score for r in after.collect()} == {"kept"}


def test_toxicity(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.trained(spark, SF)
    weights = dict(zip(model["bucket"], model["weight"]))
    stay = []
    for r in rows(before):
        buckets = {b for _, family in toxicity.features(pa.array([r.text])) for b in family.tolist()} | {toxicity.BIAS}
        if 1 / (1 + math.exp(-sum(weights.get(b, 0.0) for b in buckets))) < toxicity.THRESHOLD:
            stay.append(r)
    assert [tuple(r) for r in rows(after)] == [tuple(r) for r in stay]


def test_line_dedup(stages):
    before, after = stages["line_dedup"]
    got = {r.doc_id: r for r in rows(after)}
    docs = rows(before)
    for r, left in zip(docs, brute([r.text for r in docs], 50)):
        had = [tuple(x.encode().split()) for x in r.text.split("\n") if x.split()]
        if had and not left:
            assert r.doc_id not in got
            continue
        new = got[r.doc_id]
        assert [tuple(x.encode().split()) for x in new.text.split("\n") if x.split()] == left
        assert new.n_chars == (r.n_chars if had == left else len(new.text)) and new.source == r.source


def test_simhash(stages):
    """Shingles of five words, similarity of 0.8: the rule for near-duplicate stages on word shingles."""
    before, after = stages["simhash"]
    docs = rows(before)
    roots = components([shingles(r.text) for r in docs])
    assert [r.doc_id for r in rows(after)] == [docs[i].doc_id for i in sorted(set(roots))]


def test_cases(spark, odd, none):
    """Nulls, ties, repeated rows, clashing columns and empty tables, through every stage in turn."""
    docs = {"odd": odd, "none": none}
    for name, stage in P.STAGES:
        before = docs
        docs = {k: written(stage(spark, d, SF), name) for k, d in before.items()}
        assert docs["none"].count() == 0
        if name != "packing":
            assert all(docs[k].columns == before[k].columns for k in docs)
        if name == "line_dedup":
            assert docs["odd"].where("doc_id IS NULL").count() == 1 and docs["odd"].where("doc_id = 5").count() == 2
        if name == "simhash":
            assert sorted(r.doc_id for r in docs["odd"].collect() if r.doc_id is not None) == [1, 2, 6, 7, 8, 9]
            assert {(r.score, r.Spans, r.id == r.doc_id) for r in docs["odd"].where("doc_id IS NOT NULL").collect()} == {(1, "x", True)}
    assert docs["odd"].select("doc_id").distinct().count() == 7


def test_one_row_of_a_group_stays(spark):
    words = " ".join(f"w{k}" for k in range(60))
    data = [(1, words), (5, words), (5, words), (5, words + " and three more"), (9, words), (7, "t"), (7, "t"), (None, "t")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    assert sorted((r.doc_id, len(r.text)) for r in P.copies_out(spark, docs, SF).collect()) == [(1, len(words)), (7, 1)]


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    got = {r.doc_id: r for r in rows(after)}
    for r in rows(before):
        n, hit, _ = leaks(r.text, items, 10)
        if hit == 0:
            assert tuple(got[r.doc_id]) == tuple(r)
        elif hit == n:
            assert r.doc_id not in got
        else:
            assert len(ALNUM.findall(got[r.doc_id].text.translate(LOW))) == n - hit


def test_packing(stages):
    before, after = stages["packing"]
    pieces = after.collect()
    assert sum(r.length for r in pieces) == sum(len(ids_of(r.text)) for r in before.collect())
    assert len({r.sequence_id for r in pieces}) <= packing.lower_bound(np.array([r.length for r in pieces]), 4096) + 1


def test_url_filter_matches_its_sql(spark):
    link = '<link rel="canonical" href="{}">'
    data = [(1, "http://a.example.org/es/1?q", None), (2, "https://X.Example.ORG/en/15", ""), (3, None, "x"), (4, "none", None), (5, "http://d.net/alias", link.format("https://e.example.org/es/9")), (6, "http://f.net/x", link.format("http://d.net/alias")), (7, "http://g.com/fr/1", link.format("//d.net/alias")), (8, "http://c.net/y/k", '<meta http-equiv="refresh" content="0; url=z">')]
    c = duckdb.connect()
    pages = pd.DataFrame(data, columns=["page_id", "url", "html"])  # noqa: F841
    c.sql("CREATE TABLE pages AS SELECT page_id::BIGINT AS page_id, url::VARCHAR AS url, html::VARCHAR AS html FROM pages")
    found = c.sql(urls.SQL["op4_redirect_url_filter"])
    names = ["page_id", "host", "path", "rule", "verdict", "by_alias"]
    at = [found.columns.index(n) for n in names]
    got = urls.verdicts(spark.createDataFrame(data, "page_id long, url string, html string"), urls.RULES).select(names)
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in found.fetchall())
