"""Texts go whole into rollouts."""

import json

from loomtrace.sources import rollout


def test_answers_are_written_whole(spark, tmp_path):
    rows = [(c, n, role, text) for c, end in ((1, "x"), (2, "y")) for n, role, text in ((0, "user", "q"), (1, "assistant", "a" * 200 + end))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    lines = [json.loads(r.line) for r in rollout.derived_lines(spark, str(tmp_path)).collect() if r.line]
    assert sorted(x["payload"]["text"] for x in lines if x["payload"].get("phase") == "final_answer") == ["a" * 200 + "x", "a" * 200 + "y"]
