"""Sinks and streams, written and read back."""

import json

from pyspark.sql import functions as F

from loomtrace.sources import sinks
from loomtrace.streaming import ingest


def test_capture_keeps_bytes_once_and_every_attempt(spark, tmp_path):
    rows = spark.createDataFrame([(s, bytearray(c)) for s, c in (("a", b"one"), ("a", b"one"), ("b", b"one"), ("a", b"two"))], "source string, content binary")
    for _ in range(2):
        sinks.capture(rows, f"file://{tmp_path}/c")
    kept = sinks.payloads(spark, f"file://{tmp_path}/c").collect()
    assert sorted((r.source, bytes(r.content), r.byte_count) for r in kept) == [("a", b"one", 3), ("a", b"two", 3), ("b", b"one", 3)]
    assert spark.read.parquet(f"{tmp_path}/c/attempts").count() == 8


def test_exports_and_snapshot(spark, tmp_path):
    df = spark.range(20).select("id", F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"))
    sinks.export_jsonl(df, f"{tmp_path}/e", ["id"])
    parts = sorted(tmp_path.glob("e/part-*"))
    assert [json.loads(x)["id"] for p in parts for x in p.read_text().splitlines()] == list(range(20))
    sinks.export_splits(df, f"{tmp_path}/s")
    assert spark.read.json(f"{tmp_path}/s/split=test").count() == 10
    got = {r.name: r for r in sinks.snapshot({"x": df, "none": df.where("false")}, f"{tmp_path}/snap").collect()}
    again = {r.name: r for r in sinks.snapshot({"x": df.repartition(7)}, f"{tmp_path}/snap2").collect()}
    assert got["x"].rows == 20 and got["none"].rows == 0 and got["x"].digest == again["x"].digest


def test_late_identity_moves_earlier_spans_and_conflict_takes_it_back(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def deliver(name, *rows):
        (src / name).write_text("\n".join(json.dumps(dict(zip(("id", "trace_id", "identity"), r))) for r in rows))
        return {r.id: (r.owner, r.basis) for r in ingest.attribute_stream(spark, str(src), f"{tmp_path}/out", f"{tmp_path}/state").collect()}

    assert deliver("1.json", (1, "t", None), (2, "u", "z")) == {1: ("trace:t", "trace"), 2: ("z", "direct")}
    assert deliver("2.json", (3, "t", "x"))[1] == ("x", "only identity in trace")
    got = deliver("3.json", (4, "t", "y"))
    assert got[1] == ("trace:t", "trace") and got[3] == ("x", "direct") and got[2] == ("z", "direct")


def test_captured_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a", b"1"), ("b", b"1"), ("c", b"2")):
        (tmp_path / "in" / name).write_bytes(data)
    ingest.capture_files(spark, str(tmp_path / "in"), f"{tmp_path}/c", f"{tmp_path}/state", 1)
    assert sinks.payloads(spark, f"{tmp_path}/c").count() == 2


def test_a_repeated_batch_is_captured_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", bytearray(b"one")), ("a", bytearray(b"two"))], "source string, content binary")
    path = f"file://{tmp_path}/c"
    for batch in (0, 0, 1, 1):
        assert sinks.capture(rows, path, batch) == batch
    assert sinks.payloads(spark, path).count() == 2 and sinks.attempts(spark, path).count() == 4
    assert {r.status for r in sinks.captures(spark, path).collect()} == {"pending"}
    ids = sorted(r.capture_id for r in sinks.attempts(spark, path).collect())
    assert len(set(ids)) == 4
    sinks.finish(spark.createDataFrame([(ids[0], "3", None), (ids[1], None, "bad")], "capture_id long, result string, error string"), path)
    sinks.finish(spark.createDataFrame([(ids[1], "5", None)], "capture_id long, result string, error string"), path)
    assert {r.capture_id: r.status for r in sinks.captures(spark, path).collect()} == {ids[0]: "normalized", ids[1]: "normalized", ids[2]: "pending", ids[3]: "pending"}


def test_replaced_and_pinned_files(spark, tmp_path):
    import hashlib

    import pytest

    path = f"file://{tmp_path}/r"
    for n in (3, 5):
        sinks.replaced(spark.range(n), path)
        assert spark.read.json(path).count() == n
    assert sorted(p.name for p in tmp_path.iterdir()) == ["r"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a").write_bytes(b"x")
    good = hashlib.sha256(b"x").hexdigest()
    assert sinks.pinned(spark, f"file://{tmp_path}/f", {"a": good}).count() == 1
    for pins in ({"a": "0"}, {"a": good, "b": good}):
        with pytest.raises(ValueError):
            sinks.pinned(spark, f"file://{tmp_path}/f", pins)
