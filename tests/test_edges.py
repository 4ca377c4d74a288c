"""Rows at the edges of what queries cut, join and count, each against its query's SQL in DuckDB."""

import os

import duckdb

from loomtrace.plans import registry


def against_sql(spark, sf_dir, name):
    """The query's rows over the tables in a folder, once they are its SQL's."""
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        files = f"{sf_dir}/{f}/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else f"{sf_dir}/{f}"
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{files}'")
    found = c.sql(registry.oracle_sql()[name])
    rows = [tuple(r[k] for k in found.columns) for r in registry.queries()[name](spark, sf_dir).collect()]
    assert sorted(rows, key=str) == sorted(found.fetchall(), key=str)
    return rows


def conversations(spark, sf_dir, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{sf_dir}/conversations.parquet")


def test_a_preview_ends_with_the_space_before_a_message_that_begins_after_it(spark, tmp_path):
    rows = [(size, n, "user", text) for size in (238, 239, 240, 241) for n, text in enumerate(("a" * size, "second"))]
    conversations(spark, tmp_path, rows)
    assert dict(against_sql(spark, tmp_path, "row_preview"))[239] == "a" * 239 + " "


def reprocessed(spark, sf_dir):
    for name in ("events", "supplier"):
        os.symlink(f"/root/testdata/sf0.001/{name}.parquet", sf_dir / f"{name}.parquet")
    return {r[0]: r[2] for r in against_sql(spark, sf_dir, "reprocessed_captures")}


def test_times_past_what_doubles_tell_apart_in_nanoseconds(spark, tmp_path):
    conversations(spark, tmp_path, [(c, n, "user" if n % 2 == 0 else "assistant", f"text {n}") for c in (40_001, 60_002) for n in range(8)])
    assert reprocessed(spark, tmp_path)["conv-40001"] == "normalized"


def test_rollouts_of_many_turns_and_late_years(spark, tmp_path):
    conversations(spark, tmp_path, [(c, n, "user" if n % 2 == 0 else "assistant", f"text {n}") for c in (3, 7, 400_000) for n in range(80)])
    assert len({r[0] for r in against_sql(spark, tmp_path, "rollout_events")}) == 3
    got = reprocessed(spark, tmp_path)
    assert [got[f"conv-{c}"] for c in (3, 7, 400_000)] == ["failed", "normalized", "normalized"]


def test_groups_reach_over_sessions_that_share_different_turns(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "b"), (3, 1, "assistant", "c"), (4, 0, "user", "c"), (4, 1, "assistant", "d"), (9, 0, "user", "e")]
    conversations(spark, tmp_path, rows)
    spark.createDataFrame([(5, "d"), (6, "f"), (7, "f"), (8, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = dict(against_sql(spark, tmp_path, "connected_groups"))
    assert found == {1: -6, 2: -6, 3: -6, 4: -6, -6: -6, 9: 9, -7: -8, -8: -8, -9: -9}
