"""Operators on hand-made rows with known results."""

from pyspark.sql import functions as F

from loomtrace.functions import text as X
from loomtrace.operators import graph, intervals, labels, lineage, merge, similarity, splits, turns, usage

SECOND = 1_000_000


def spans(spark, rows):
    return spark.createDataFrame([(i, "s", "tool", a * SECOND, None if b is None else b * SECOND) for i, (a, b) in enumerate(rows)], "id long, session_id string, kind string, start_us long, end_us long")


def test_union_is_not_the_sum(spark):
    r = intervals.measure(spans(spark, [(2, 5), (3, 7), (9, None)]), ["session_id"]).first()
    assert (r.n, r.n_closed, r.sum_ms, r.active_ms) == (3, 2, 7000.0, 5000.0)
    r = intervals.measure(spans(spark, [(1, None)]), ["session_id"]).first()
    assert (r.sum_ms, r.active_ms) == (None, None)


def test_chain_is_one_group(spark):
    df = spans(spark, [(0, 3), (2, 5), (4, 7)])
    g = intervals.overlap_groups(df, ["session_id"], ["session_id"]).collect()
    assert [(r.label, r["size"]) for r in g] == [("P1", 3)]
    c = intervals.concurrency(df, ["session_id"]).first()
    assert (c.peak, c.overlap_ms) == (2, 2000.0)
    c = intervals.concurrency(spans(spark, [(0, 10), (1, 7), (2, 6)]), ["session_id"]).first()
    assert (c.peak, c.overlap_ms) == (3, 6000.0)


def test_touching_and_empty_intervals_do_not_overlap(spark):
    assert intervals.overlap_groups(spans(spark, [(0, 2), (2, 5), (3, 3), (4, None)]), ["session_id"], ["session_id"]).count() == 0


def test_counter_reset_and_repeats(spark):
    rows = [("a", 1, 100), ("a", 2, 100), ("a", 3, 250), ("a", 4, 50), ("a", 5, 80)]
    got = usage.counter_deltas(spark.createDataFrame(rows, "session_id string, line_number int, counter long"), "counter").orderBy("line_number").collect()
    assert [(r.line_number, r.delta, r.reset) for r in got] == [(1, 100, False), (3, 150, False), (4, None, True), (5, 30, False)]


def test_price_is_exact(spark):
    rate = spark.createDataFrame([("m", "2.0", "0.2", "10.0", 1500, "2.00", "1.50")], "model string, a string, b string, c string, long_over long, d string, e string")
    rate = rate.selectExpr("model", "cast(a as decimal(12,6)) input_rate", "cast(b as decimal(12,6)) cached_rate", "cast(c as decimal(12,6)) output_rate", "long_over", "cast(d as decimal(4,2)) long_input", "cast(e as decimal(4,2)) long_output")
    rows = [("m", 1000, 200, 100), ("m", 2000, 0, 100), ("m", 10, 20, 1), ("x", 1, 1, 1), ("m", 5, None, 5)]
    got = usage.priced(spark.createDataFrame(rows, "model string, input_tokens long, cached_tokens long, output_tokens long"), rate).collect()
    assert sorted((str(r.cost), r.reason, r.long_context) for r in got) == sorted([("0.00264000000000", None, False), ("0.00950000000000", None, True), ("None", "more cached than input", False), ("None", "no rate", False), ("None", "unknown cached tokens", False)])


def test_unknown_poisons_a_sum(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "k string, v long")
    assert {r.k: r.s for r in df.groupBy("k").agg(usage.known_sum("v").alias("s")).collect()} == {"a": None, "b": 2}


def test_carry_keeps_an_explicit_null(spark):
    rows = [("s", 1, "m1", True), ("s", 2, "x", False), ("s", 3, None, True), ("s", 4, "y", False)]
    got = usage.carried(spark.createDataFrame(rows, "session_id string, line_number int, model string, sets boolean"), "model", F.col("sets")).orderBy("line_number").collect()
    assert [r.carried for r in got] == ["m1", "m1", None, None]


def test_metrics_of_a_known_confusion(spark):
    pairs = spark.createDataFrame([(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2, "actual int, predicted int")
    got = {r["class"]: r for r in labels.metrics(pairs, [0, 1, 2]).collect()}
    assert (got[0].precision, got[0].recall, got[1].precision, got[1].recall) == (1.0, 0.75, round(2 / 3, 9), 1.0)
    assert got[2].f1 == 0.0 and got[0].accuracy == round(5 / 6, 9) and got[0].macro_f1 == round((6 / 7 + 4 / 5) / 3, 9)


def test_fold_policies(spark):
    rows = [("a", 1, "a", "2024", "trace", None), ("a", 2, "Title", "2023", "session", "p"), ("a", 3, "a", "2025", "trace", "q")]
    r = merge.fold_sessions(spark.createDataFrame(rows, "session_id string, sequence int, title string, started_at string, identity_kind string, producer string")).first()
    assert (r.title, r.started_at, r.identity_kind, r.producer, r.deliveries) == ("Title", "2023", "session", "p", 3)


def test_attribution_bases(spark):
    rows = [(1, "t", "x"), (2, "t", None), (3, "u", "x"), (4, "u", "y"), (5, "u", None)]
    got = {r.id: (r.owner, r.basis) for r in merge.attribute_traces(spark.createDataFrame(rows, "id int, trace_id string, identity string")).collect()}
    assert got == {1: ("x", "direct"), 2: ("x", "only identity in trace"), 3: ("x", "direct"), 4: ("y", "direct"), 5: ("trace:u", "trace")}


def test_nearest_identity_over_a_cycle(spark):
    rows = [(1, None, "root"), (2, 1, None), (3, 2, None), (4, 3, "own"), (5, 4, None), (6, 7, None), (7, 6, None)]
    got = {r.id: r.identity for r in turns.nearest_identity(spark.createDataFrame(rows, "id int, parent int, identity string")).collect()}
    assert got == {1: "root", 2: "root", 3: "root", 4: "own", 5: "own", 6: None, 7: None}


def test_cosine_blocks_agree_with_one_block(spark):
    rows = [(i, [float((i * k) % 7 - 3) for k in range(1, 9)]) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, e array<float>").select("id", similarity.unit("e").alias("vector"))
    one, many = (sorted(map(tuple, similarity.cosine_pairs(v, 0.6, n).collect())) for n in (1000, 9))
    assert one == many and one


def test_chunks_end_with_the_text(spark):
    df = spark.createDataFrame([("abcdefghij",), ("abc",), ("  ",), ("abcdefg",)], "t string")
    got = [[(x.start, x.chunk) for x in r.c] for r in df.select(X.chunks(F.col("t"), 4, 1).alias("c")).collect()]
    assert got == [[(0, "abcd"), (3, "defg"), (6, "ghij")], [(0, "abc")], [], [(0, "abcd"), (3, "defg")]]


def test_nine_digit_timestamps(spark):
    got = spark.range(1).select(X.nanos_string(F.lit(1_700_000_000_123_456)).alias("a")).first().a
    assert got == "2023-11-14T22:13:20.123456000Z"


def test_dependencies_of_any_depth(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)], "node int, needs int")
    got = graph.dependencies(spark.createDataFrame([(0,)], "root int"), chain).collect()
    assert sorted((r.node, r.depth) for r in got) == [(i, i) for i in range(71)]


def test_dependencies_end_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c")], "node string, needs string")
    got = graph.dependencies(spark.createDataFrame([("a",), ("d",), ("z",)], "root string"), edges).collect()
    assert sorted(map(tuple, got)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("d", "a", 2), ("d", "b", 3), ("d", "c", 1), ("d", "d", 0), ("z", "z", 0)]


def test_identity_at_the_top_of_a_long_chain(spark):
    rows = [(i, i + 1 if i < 40 else None, "top" if i == 40 else None) for i in range(41)]
    got = turns.nearest_identity(spark.createDataFrame(rows, "id int, parent int, identity string")).collect()
    assert {r.identity for r in got} == {"top"} and len(got) == 41


def test_chains_without_end(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 5), (5, 6), (6, 4), (7, 4), (8, 7), (9, 9)] + [(i, i + 1) for i in range(20, 60)] + [(60, None)]
    assert sorted(r.id for r in turns.without_end(spark.createDataFrame(rows, "id int, parent int")).collect()) == [4, 5, 6, 7, 8, 9]


def test_leaves_of_any_depth(spark):
    doc = '{"a":{"b":{"c":{"d":{"e":{"f":[{"g":1},[]]}}}}},"x/y":{"~":null},"z":{}}'
    got = {r.pointer: (r.type, r.value) for r in lineage.leaves(spark.createDataFrame([(1, doc), (2, None), (3, "5")], "id int, doc string"), "id", "doc").where("id = 1").collect()}
    assert got == {"/a/b/c/d/e/f/0/g": ("bigint", "1"), "/a/b/c/d/e/f/1": ("array", "[]"), "/x~1y/~0": ("void", "null"), "/z": ("object", "{}")}


def test_few_groups_still_fill_every_split(spark):
    got = {r.group_id: r.split for r in splits.best_deal(spark.createDataFrame([("a", 5), ("b", 9), ("c", 1)], "group_id string, n long"), 1).collect()}
    assert sorted(got.values()) == ["test", "train", "validation"]


def test_previous_turn_of_repeats(spark):
    rows = [(1, 0, "a"), (1, 0, "b"), (1, 1, "c"), (1, 3, "d")]
    got = sorted((r["index"], r.role, r.before) for r in turns.previous(spark.createDataFrame(rows, "session_id int, index int, role string"), "role", "before").collect())
    assert got == [(0, "a", None), (0, "b", None), (1, "c", "b"), (3, "d", None)]


def test_thresholds_out_of_range_are_refused():
    import pytest

    for wrong in (0.05, 1.01, float("nan"), True):
        with pytest.raises(ValueError):
            similarity.checked_threshold(wrong)
    assert similarity.checked_threshold(1) == 1.0


def test_decisions_see_the_revision_they_name(spark):
    from loomtrace.operators import curation

    said = [
        (0, 0, "remove_left", "p1", None), (1, 0, "verify", "a", "x"), (2, 1, "remove_left", "p2", None), (3, 1, "keep_both", "p1", None), (4, 1, "restore", "a", None), (5, 2, "keep_both", "p1", None),
        (6, 3, "remove_left", "p1", None), (7, 4, "reopen_pair", "p1", None), (8, 4, "restore", "a", None), (9, 5, "restore", "a", None), (10, 6, "what", "a", None), (11, 6, "verify", "b", "x"),
        (12, 6, "verify", "b", "odd"), (13, 6, "verify", "zz", "x"), (14, 6, "keep_both", "p9", None), (15, 6, "verify", "b", "x"), (16, 7, "reopen_label", "b", None), (17, 8, "remove_right", "p2", None),
    ]
    log = spark.createDataFrame([("w", *r, "me" if r[0] != 11 else " ", "so") for r in said], "workspace string, sequence long, revision long, action string, target string, category string, reviewer string, reason string")
    turns = spark.createDataFrame([("w", i) for i in "abc"], "workspace string, id string")
    pairs = spark.createDataFrame([("w", "p1", "a", "b"), ("w", "p2", "b", "c")], "workspace string, id string, `left` string, `right` string")
    got = {r.sequence: r for r in curation.decided(log, turns, pairs, ("x", "y")).collect()}
    assert {i: r.why for i, r in got.items() if r.why} == {
        1: "stale revision", 2: "others were removed for it", 3: "pair is not active", 7: "pair is not active", 10: "unknown action",
        11: "no reviewer or reason", 12: "unknown category", 13: "unknown target", 14: "unknown target",
    }
    assert [got[i].removed for i in (0, 4, 6, 8, 9, 17)] == [1, 0, 1, 0, 0, 1] and [got[i].verified for i in (15, 16)] == [1, 0]
    # what removed a turn is pending again once it is restored
    assert [got[i].reopened for i in (0, 4, 5, 6, 8)] == [0, 1, 0, 0, 1] and got[17].after == 9

