"""SimHash candidates of the near-copy stage, and prefixes without a join by shingle."""

import random
from collections import Counter

from pyspark.sql import functions as F

from loomtrace.llm import near_copies


def test_fingerprints_within_two_bits_are_compared(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(62) for _ in range(40)]
    prints += [p ^ 1 << rng.randrange(62) ^ 1 << rng.randrange(62) for p in prints] + prints[:5]
    sets = list(enumerate(prints))
    pairs = near_copies.fingerprint_pairs(spark.createDataFrame(sets, "set_id long, fp long")).collect()
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in pairs:
        assert u > v
        root[find(u)] = find(v)
    close = [(a, b) for a, x in sets for b, y in sets if a < b and (x ^ y).bit_count() <= 2]
    assert len(close) >= 45 and all(find(a) == find(b) for a, b in close)


def test_fingerprints_are_of_the_sets_shingles(spark):
    words = " ".join(f"w{k}" for k in range(400))
    docs = spark.createDataFrame([(1, words, 1), (2, words + " x", 2), (3, None, 3)], "doc_id long, text string, text_key long").withColumn("id", F.col("doc_id"))
    rows = docs.select("doc_id", "id", "text_key", "text").mapInArrow(near_copies._bands, "doc_id long, id long, text_key long, set_id long, fp long, keys array<long>").collect()
    fps = {r.doc_id: r.fp for r in rows}
    assert fps[3] == 0 and bin((fps[1] ^ fps[2]) & (1 << 64) - 1).count("1") <= 6 and fps[1] != 0


def test_prefixes_join_only_what_may_be_similar(spark):
    """Shingles that all sets have aren't looked up by join, and every similar pair is found."""
    rng = random.Random(3)
    common = [rng.randrange(1 << 62) for _ in range(300)]
    sets = []
    for k in range(60):
        own = [rng.randrange(1 << 62) for _ in range(120)]
        sets += [(2 * k, common + own), (2 * k + 1, common + own[:100] + [rng.randrange(1 << 62) for _ in range(20)])]
    of = spark.createDataFrame(sets, "set_id long, hashes array<long>")
    got = near_copies.prefix_pairs(of.select("set_id", F.col("set_id").alias("root")), of)
    assert {(2 * k, 2 * k + 1) for k in range(60)} <= {tuple(sorted(r)) for r in got.collect()}


def test_shingles_are_counted_without_a_row_for_each(spark):
    rng = random.Random(7)
    sets = [(k, [rng.getrandbits(63) - (1 << 62) for _ in range(rng.randrange(400))]) for k in range(60)] + [(60 + k, [5, -5, 1 << 40]) for k in range(3000)]
    df = near_copies.shelf_counts(spark.createDataFrame(sets, "set_id long, hashes array<long>").repartition(3))
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()
    wanted = Counter(h % near_copies.PLACES for _, own in sets for h in own)
    got = {r.shelf * near_copies.SHELF + k: n for r in df.collect() for k, n in enumerate(r.n) if n}
    assert got == wanted
    assert near_copies.shelf_counts(spark.createDataFrame([(1, [])], "set_id long, hashes array<long>")).count() == 0
