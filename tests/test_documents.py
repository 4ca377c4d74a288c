"""Vectorized functions, rate cards and sealed folders."""

import pytest
from pyspark.sql import functions as F

from loomtrace.functions import documents as D
from loomtrace.sources import rates, sinks


def test_merge_patch():
    assert D.merged({"a": 1, "b": {"c": 2, "d": 3}}, {"a": None, "b": {"c": 4, "e": None}, "f": [1]}) == {"b": {"c": 4, "d": 3}, "f": [1]}
    assert D.merged([1], {"a": 1}) == {"a": 1} and D.merged({"a": 1}, 5) == 5


def test_functions_on_nulls(spark):
    df = spark.createDataFrame([("ﬁ  ½ x\n", '{"a":1}', [0.5, 1.0]), (None, None, None)], "t string, j string, v array<double>")
    got = df.select(D.normalized(F.col("t")).alias("n"), D.merge_patch(F.col("j"), F.lit('{"b":null}')).alias("p"), D.vector_digest(F.col("v")).alias("d"), D.fit_parts(F.col("t"), 3).alias("f")).collect()
    assert (got[0].n, got[0].p, len(got[0].d), "".join(got[0].f)) == ("fi 1⁄2 x", '{"a":1}', 64, "ﬁ  ½ x\n")
    assert (got[1].n, got[1].p, got[1].d, got[1].f) == (None, None, None, [])


def test_parts_join_to_the_text():
    for text in ("", "a b " * 300, "x" * 1000, "one\n" * 50 + "y" * 600):
        parts = D.fitted(text, 64)
        assert "".join(parts) == text and all(len(p) <= 64 for p in parts)


def test_rate_card(spark):
    card = '[aliases]\nb = "a"\n[models.a]\ninput = "1.25"\noutput = "10"\n'
    got = {r.model: (r.canonical, str(r.input), r.cached_input) for r in rates.read_card(spark, card).collect()}
    assert got == {"a": ("a", "1.250000", None), "b": ("a", "1.250000", None)}
    for bad in (card.replace('"1.25"', "1.25"), card.replace('"1.25"', '"1e3"'), card.replace('b = "a"', 'b = "z"')):
        with pytest.raises(ValueError):
            rates.parse(bad)


def test_sealed_folder(spark, tmp_path):
    root = tmp_path / "sealed"
    root.mkdir()
    for name in ("a", "b", "c"):
        (root / name).write_text(name)
    seal = spark.createDataFrame(sinks.inventory(spark, str(root)).collect())
    assert sinks.altered(spark, str(root), seal).count() == 0
    (root / "a").write_text("changed")
    (root / "b").unlink()
    (root / "d").write_text("new")
    assert {r.name: r.state for r in sinks.altered(spark, str(root), seal).collect()} == {"a": "changed", "b": "missing", "d": "added"}


def test_commands_and_templates(spark):
    df = spark.createDataFrame([(["ls", "a b"],), (None,)], "c array<string>")
    assert [r.x for r in df.select(D.command_text(F.col("c")).alias("x")).collect()] == ["ls 'a b'", ""]
    with pytest.raises(ValueError):
        D.rendered("{a} {b}", a=F.lit("x"))
    with pytest.raises(ValueError):
        D.rendered("{a}", a=F.lit("x"), b=F.lit("y"))


def test_bounded_gzip(spark):
    import gzip

    body = b"x" * 1000
    rows = [(1, body, None), (2, gzip.compress(body), "gzip"), (3, gzip.compress(body * 2), "gzip"), (4, gzip.compress(body) + b"more", "gzip"), (5, gzip.compress(body)[:-3], "gzip"), (6, body, "br"), (7, None, None)]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b), e) for i, b, e in rows], "i int, content binary, encoding string")
    got = {r.i: r.b for r in df.select("i", D.decoded_body(F.col("content"), F.col("encoding"), 1500).alias("b")).collect()}
    assert bytes(got[1]) == bytes(got[2]) == body and all(got[i] is None for i in range(3, 8))
