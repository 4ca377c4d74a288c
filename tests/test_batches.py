"""Microbatches against a reader that fills them in order."""

import random

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import batches


def filled(lengths, size, budget):
    out, batch = [], []
    for x in lengths:
        if batch and (len(batch) == size or (budget and max(*batch, x) * (len(batch) + 1) > budget)):
            out.append(batch)
            batch = []
        batch.append(x)
    return [*out, batch] if batch else out


@pytest.mark.parametrize("n,size,budget,stretch", [(0, 3, 9, 2), (1, 1, 5, 1), (200, 4, 30, 2), (150, 7, None, 1), (300, 5, 12, 3), (90, 1, None, 4)])
def test_as_filled_in_order(spark, monkeypatch, n, size, budget, stretch):
    random.seed(n)
    monkeypatch.setattr(batches, "STRETCH", stretch)
    lengths = [random.choice([1, 2, 3, 5, 8, 11]) for _ in range(n)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lengths)], "id int, n int").repartition(3)
    got = batches.microbatches(rows, "n", [F.col("id")], size, budget).orderBy("batch", "place").collect()
    assert [r.id for r in got] == list(range(n))
    want = filled(lengths, size, budget)
    assert [(r.batch, r.place) for r in got] == [(b, k) for b, batch in enumerate(want) for k in range(len(batch))]


def test_what_fits_nowhere_is_refused(spark):
    rows = spark.createDataFrame([(1, 9)], "id int, n int")
    for size, budget in ((2, 8), (0, None), (2, 0)):
        with pytest.raises(ValueError):
            batches.microbatches(rows, "n", [F.col("id")], size, budget)
