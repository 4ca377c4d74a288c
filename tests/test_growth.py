"""Work that grows no faster than the tables: how often plans deal and sort rows, how often vectors are sent."""

import pytest

from loomtrace.operators import session_usage as S
from loomtrace.operators import lineage, similarity, turns
from loomtrace.plans import review_queries as R
from loomtrace.plans import session_queries as Q

DATA = "/root/testdata/sf0.001"


def plan(df, what):
    return df._jdf.queryExecution().executedPlan().toString().count(what)


@pytest.mark.parametrize("query, deals, sorts", [("usage_priced_counters", 1, 3), ("usage_summary_scopes", 1, 4), ("usage_findings", 1, 5), ("session_usage", 3, 11), ("session_usage_findings", 3, 11)])
def test_sessions_are_dealt_once(spark, query, deals, sorts):
    df = Q.QUERIES[query](spark, DATA)
    assert plan(df, "Exchange hashpartitioning") <= deals and plan(df, "Sort [") <= sorts


def test_accounts_of_four_tables_are_those_of_their_entries(spark):
    records, counters = Q.records(spark, DATA).where("session_id % 3 != 1"), Q.counter_records(spark, DATA).where("session_id % 3 != 0")
    silent = "line_number % 5 = 0 AND session_id % 2 = 0"
    scope, said = Q._said()
    summaries = S.response_rows(records).where("tokens IS NOT NULL").select("session_id", "line_number", "turn_id", scope.alias("scope"), said.alias("tokens"))
    parts = S.session_accounts(records, counters.where(f"NOT ({silent})"), counters.where(silent).select("session_id"), summaries)
    whole = Q._accounts(spark, DATA)
    for one, other in zip(parts[1:], whole[1:]):
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


def test_a_vector_is_sent_as_often_however_many_there_are():
    assert similarity.blocks(20_000) == similarity.blocks(500_000) == similarity.BLOCKS
    assert similarity.blocks(10) == 1 and similarity.blocks(10, 3) == 4 and similarity.blocks(1 << 20) == 16


def test_labels_come_along_with_vectors(spark):
    df = R.pair_queue(spark, DATA)
    assert plan(df, "Join") == 0 and df.count()
    vectors = spark.createDataFrame([(3, [1.0, 0.0], 7), (1, [1.0, 0.0], 8), (2, [0.0, 1.0], None)], "id long, vector array<double>, label int")
    for rows in (1, 2, None):
        assert list(map(tuple, similarity.cosine_pairs(vectors, 0.5, rows, ("label",)).collect())) == [(1, 3, 8, 7, 1.0)]


def test_settled_nodes_are_written_once(spark):
    rows = [(k, k - 1 if k else None, "top" if not k else None) for k in range(9)] + [(20, 21, None), (21, 20, None), (30, 99, None)]
    df = turns.nearest_identity(spark.createDataFrame(rows, "id int, parent int, identity string"))
    got = dict(map(tuple, df.collect()))
    assert got == {k: "top" if k < 9 else None for k, _, _ in rows}
    folder = df.inputFiles()[0].rpartition("/round=")[0]
    counts = {r["round"]: r["count"] for r in spark.read.parquet(folder).groupBy("round").count().collect()}
    assert counts[0] == 12 and counts[1] == 11 and counts[2] < 11


def test_leaves_are_written_once_and_dealt_once(spark, monkeypatch):
    kept, put = [], lineage.written
    monkeypatch.setattr(lineage, "written", lambda df, name: kept.append(name) or put(df, name))
    deep = lambda n: '{"a/b":[' * n + "7" + ',{}]}' * n
    docs = spark.createDataFrame([(1, deep(4)), (1, deep(4)), (1, '{"c":null}'), (2, deep(11)), (3, "[]")], "id int, doc string")
    rows = lineage.leaves(docs.where("id != 2"), "id", "doc")
    assert len(kept) == 1 and rows.count() == 2 * 5 + 2
    said = spark.createDataFrame([("", "top"), ("/a~1b/0", "mid"), ("/a~1b/0", "low"), ("/a~1b/0/a~1b", None), ("/x", "other")], "pointer string, origin string")
    found = lineage.described(lineage.leaves(docs, "id", "doc"), "id", said)
    plan_text = found._jdf.queryExecution().executedPlan().toString()
    # nothing is combined, and so kept in memory or spilled, before it is dealt
    assert "Generate" not in plan_text and plan_text.count("Exchange hashpartitioning(id") == 1 and "HashAggregate" not in plan_text.partition("Exchange hashpartitioning(id")[2].partition("BroadcastExchange")[0]
    step, wanted = "/a~1b/", {(1, "/c", "null", "top"), (3, "", "[]", "top")}
    for owner, n in ((1, 4), (2, 11)):
        at = (step + "0") * (n - 1)
        wanted |= {(owner, at + step + "0", "7", "mid")} | {(owner, (step + "0") * k + step + "1", "{}", "mid" if k else "top") for k in range(n)}
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    assert {r.origin for r in lineage.described(rows, "id", said.where("false")).collect()} == {None}


def test_numbers_of_leaves_are_as_before(spark):
    doc = '{"a":1.0,"b":1e2,"c":{"b":1e2,"e":{"a":1.50,"d":1.5e300,"f":"1.0"}}}'
    got = {r.pointer: (r.type, r.value) for r in lineage.leaves(spark.createDataFrame([(1, doc)], "id int, doc string"), "id", "doc").collect()}
    assert got == {"/a": ("bigint", "1"), "/b": ("decimal", "100"), "/c/b": ("bigint", "100"), "/c/e/a": ("decimal", "1.5"), "/c/e/d": ("double", "1.5E300"), "/c/e/f": ("string", '"1.0"')}
