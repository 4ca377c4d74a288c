"""What is settled is certified by the bound of its own pieces."""

import random
from collections import defaultdict

import numpy as np

from loomtrace.llm import packing


def settled(spark, lengths, capacity, pieces_each):
    rows = [(i, n) for i, n in enumerate(lengths)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, length long"), capacity, pieces_each).collect()
    assert sorted((r.doc_id, r.length) for r in got) == rows
    parts, filled = defaultdict(list), defaultdict(int)
    for r in got:
        parts[r.sequence_id >> 24].append(r)
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= capacity
    return parts


def test_bins_and_bound_are_of_what_is_settled(spark):
    random.seed(6)
    parts = settled(spark, [random.choice((random.randrange(1, 100), random.randrange(34, 60))) for _ in range(1500)], 100, 100)
    assert len(parts) > 1
    last = max(k >> 32 for k in parts)
    for k, rows in parts.items():
        n, bound = len({r.sequence_id for r in rows}), packing.lower_bound(np.array([r.length for r in rows]), 100)
        assert {(r.part_bins, r.part_bound) for r in rows} == {(n, bound)}
        assert n == bound or k >> 32 == last


def test_a_certified_partition_is_settled_whole(spark):
    """No two fit together: nothing is to be gained by dealing them anew, though no sequence is full."""
    parts = settled(spark, [60] * 400, 100, 100)
    assert {k >> 32 for k in parts} == {0} and all(r.part_bins == r.part_bound for rows in parts.values() for r in rows)


def test_partitions_with_a_gap_exchange(spark):
    """Pieces of one length need dealing to fill up: no partition with more sequences than its bound is settled before the last round."""
    random.seed(8)
    parts = settled(spark, [random.choice((51, 34, 26, 17, 9)) for _ in range(3000)], 100, 150)
    last = max(k >> 32 for k in parts)
    assert last > 0
    assert all(r.part_bins == r.part_bound for k, rows in parts.items() if k >> 32 < last for r in rows)


def test_equal_rows_are_dealt_apart(spark):
    got = packing.pack(spark.range(2000).selectExpr("1L AS doc_id", "60L AS length"), 100, 500).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.sequence_id >> 24] += 1
    assert len(sizes) == 4 and max(sizes.values()) < 700 and len({r.sequence_id for r in got}) == 2000
