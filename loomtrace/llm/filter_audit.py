"""What each of five filters removes, alone and in any order.

A row fails a set of filters, written as five bits. A to D are properties of its
text. E, a text that a smaller doc_id has too, is an existential self-join: rows
whose hash occurs under several ids are left-semi joined with the rows of the same
hash, the exact same text and a smaller id; of those, the least id of each text is
enough. The rows that E marks are then united with what all rows fail otherwise,
as a row of one bit combination less and one more of the other, and the
combinations are counted by part. Everything about an order follows from the 32
counts of a part: a row goes at the first filter of the order that it fails.

A few copied texts may be a third of all rows: counts and least ids combine before
the shuffle, and a hot hash is dealt anew for the join. Texts of rows whose hash
occurs under one id alone aren't shuffled while the hashes that occur under several
are few enough to broadcast (BROADCAST_HASHES); beyond that a join by hash finds
the same rows.

Cases: a null or empty text has no words, fails A alone of A to D (no words: no
half of them distinct is missing) and is a copy of any other. A null doc_id is
smaller than none and has no labels. A null source is the part of the empty string.
Repeated rows count each; rows of one doc_id aren't copies of each other. Several
labels of an id count if one of them says so. A very long text is taken whole, in
one row. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.shared import Scratch, table, written
from loomtrace.operators.graph import dealt_anew

FILTERS = "ABCDE"
#: 16 MB of hashes; above, they are joined by a shuffle.
BROADCAST_HASHES = 2_000_000
_COPY = 1 << FILTERS.index("E")


def text_failures(text):
    """Bits of A to D for a text without nulls."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    bits = (n < 200, 100 * distinct < 50 * n, 100 * capitals.cast("long") > 2 * F.length(text), text.rlike("[#$%&*|]"))
    return sum((F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(bits)), F.lit(0))


def copies(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, h and more) with a smaller doc_id's text; ``shared``: the hashes that several ids have."""
    few = shared.count() <= BROADCAST_HASHES
    rows = docs.join(F.broadcast(shared) if few else dealt_anew(shared, "h"), "h", "left_semi")
    least = rows.groupBy("h", "text").agg(F.min("doc_id").alias("least"))
    least = dealt_anew(least, "h").select("h", F.col("text").alias("same"), "least")
    return rows.alias("a").join(least.alias("b"), F.expr("a.h = b.h AND a.text = b.same AND b.least < a.doc_id"), "left_semi")


def combinations(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """part, mask (bits of the filters that a row fails), good, toxic, n: how many rows. ``marks``: doc_id, quality, toxic."""
    texts = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    with Scratch(docs.sparkSession) as aside:
        rows = aside.written(texts.select("doc_id", "part", "h", text_failures(F.col("text")).alias("mask")), "failures")
        shared = aside.written(rows.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h"), "shared-hashes")
        also = copies(texts, shared).select("doc_id", "part", text_failures(F.col("text")).alias("mask"))
        moved = F.array(F.struct(F.col("mask"), F.lit(-1).alias("n")), F.struct((F.col("mask") + _COPY).alias("mask"), F.lit(1).alias("n")))
        each = rows.select("doc_id", "part", "mask", F.lit(1).alias("n")).unionByName(also.select("doc_id", "part", F.inline(moved)))
        yes = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(k) for c, k in (("quality", "good"), ("toxic", "bad"))]
        labels = marks.groupBy("doc_id").agg(*yes)
        each = each.join(dealt_anew(labels, "doc_id"), "doc_id", "left")
        kind = [F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("bad", F.lit(False)).alias("toxic")]
        return written(each.groupBy("part", "mask", *kind).agg(F.sum("n").alias("n")).where("n > 0"), "combinations")


def orders() -> list[dict]:
    """Every order of the filters with its steps: the filter's bit and those of the filters before it."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for k, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            steps.append({"filter_order": "".join(order), "step": k + 1, "bit": bit, "before": before})
            before |= bit
    return steps


def audit(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step in it, with what goes and what stays there."""
    # at most 128 combinations a part
    counts = combinations(docs, marks).groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("counts"))
    steps = F.from_json(F.lit(json.dumps(orders())), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    rows = counts.select("part", "counts", F.inline(steps))

    def total(test, value=lambda c: c["n"]):
        return F.aggregate(F.filter("counts", test), F.lit(0).cast("long"), lambda s, c: s + value(c))

    def fails(c):
        return c["mask"].bitwiseAND(F.col("bit")) != 0

    def gone(c):
        return c["mask"].bitwiseAND(F.col("before")) != 0

    def here(c):
        return fails(c) & ~gone(c)

    # each of a row's failed filters comes first among them in an equal share of the 120 orders
    shares = F.array(*[F.lit(120 // k) for k in range(1, 6)])
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda c: ~fails(c) & ~gone(c)).alias("kept"),
        total(here).alias("removed"),
        total(lambda c: fails(c) & gone(c)).alias("redundant"),
        total(lambda c: c["mask"] == F.col("bit")).alias("unique_fails"),
        total(lambda c: here(c) & c["good"]).alias("good_lost"),
        total(lambda c: here(c) & c["toxic"]).alias("toxic_lost"),
        total(fails, lambda c: c["n"] * F.element_at(shares, F.bit_count(c["mask"]))).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_SQL = r"""
WITH docs AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), words AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM docs
), fails AS (
    SELECT doc_id, part,
        len(ws) < 200 AS A,
        100 * len(list_distinct(ws)) < 50 * len(ws) AS B,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS C,
        regexp_matches(text, '[#$%&*|]') AS D,
        coalesce(least < doc_id, false) AS E
    FROM words
), marks AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id
), sums AS (
    SELECT part, A::INT + 2 * B::INT + 4 * C::INT + 8 * D::INT + 16 * E::INT AS mask,
        count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (bad) AS n_bad
    FROM fails LEFT JOIN marks USING (doc_id) GROUP BY ALL
), letters(letter, bit) AS (
    VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
    SELECT filter_order, step, bits[step] AS bit, list_sum([0] || bits[1:step - 1])::INT AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)
), at_steps AS (
    SELECT part, filter_order, step, bit,
        coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0) AS kept,
        coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS removed,
        coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0) AS redundant,
        coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
        coalesce(sum(n_good) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS good_lost,
        coalesce(sum(n_bad) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS toxic_lost
    FROM sums, steps GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM at_steps
"""

QUERIES = {"op13_filter_audit": op13_filter_audit}
SQL = {"op13_filter_audit": _SQL}
