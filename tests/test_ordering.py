import pytest
from pyspark.sql import functions as F

from loomtrace.operators.ordering import row_numbers, with_exclusive_sum
from loomtrace.sources.storage import Written


@pytest.mark.parametrize("ids", [[5, 3, None, 70, 100_000, -(2**62) - 5, 2**62 + 7], [1], [], [None] * 3 + [4] * 500])
def test_sums_follow_the_order(spark, ids):
    df = spark.createDataFrame([(i, k + 1) for k, i in enumerate(ids)], "k long, v long")
    got = {r.v: r.out for r in with_exclusive_sum(df, [F.col("k").asc_nulls_first(), F.col("v")], "v", "out").collect()}
    total, want = 0, {}
    for j in sorted(range(len(ids)), key=lambda j: (ids[j] is not None, ids[j] or 0, j)):
        want[j + 1] = total
        total += j + 1
    assert got == want


def test_rows_are_numbered(spark):
    got = row_numbers(spark.range(1000).selectExpr("-id AS id"), [F.col("id")], "n").collect()
    assert sorted((r.n, r.id) for r in got) == [(n, n - 999) for n in range(1000)]


def test_only_the_last_version_stays(spark):
    rounds, paths = Written(spark, "versions"), []
    for n in (3, 4, 5):
        last = rounds.put(spark.range(n))
        paths.append(rounds.path)
    assert last.count() == 5
    there = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert [p.getFileSystem(conf).exists(p) for p in there] == [False, False, True]
