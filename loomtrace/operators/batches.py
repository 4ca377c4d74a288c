"""Microbatches under a padded-token budget, as one reader in order would fill them.

A batch takes rows in order until it has ``size`` of them or until the longest times
their number would pass the budget. Where a batch that begins at a row ends depends
on the ``size`` rows from there alone, so every row knows where the batch after its
own would begin. Which of these beginnings are real is a chain over all rows: rows
are cut into stretches, each stretch says for every row it may be entered at where it
is left, and pointer doubling over these few rows marks the entries. No task walks
more than a stretch.

Cases: rows are ordered by the given columns; end them with one that tells rows
apart. A length under one counts as one. A row longer than the budget raises, as it
fits in no batch. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.operators.ordering import row_numbers, with_exclusive_sum
from loomtrace.sources.storage import Scratch, written

#: Batches of full size in a stretch.
STRETCH = 64


def ends(lengths: np.ndarray, size: int, budget: int | None) -> np.ndarray:
    """For each row how many rows a batch has that begins there."""
    n = len(lengths)
    count, longest, open_ = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(min(size, n)):
        longest[: n - k] = np.maximum(longest[: n - k], lengths[k:])
        open_[: n - k] &= budget is None or longest[: n - k] * (k + 1) <= budget
        open_[n - k :] = False
        count += open_
    return count


def _walk(at: int, count: np.ndarray, end: int) -> list[int]:
    """The beginnings from ``at`` on, and the first at or after ``end``."""
    out = [at]
    while out[-1] < end:
        out.append(out[-1] + int(count[out[-1]]))
    return out


def microbatches(rows: DataFrame, length: str, order: list[Column], size: int, budget: int | None = None) -> DataFrame:
    """Add batch (from 0, in order) and place (in the batch, from 0) to ``rows``; ``length``: the column of tokens."""
    for bound in (size, budget):
        if bound is not None and (not isinstance(bound, int) or bound <= 0):
            raise ValueError("size and budget must be positive whole numbers")
    tokens = F.greatest(F.col(length).cast("long"), F.lit(1))
    if budget is not None and not rows.where(tokens > budget).isEmpty():
        raise ValueError("a row is longer than the budget")
    spark, each = rows.sparkSession, size * STRETCH
    with Scratch(spark) as aside:
        numbered = aside.written(row_numbers(rows, order, "row place"), "numbered")
        own = F.floor(F.col("row place") / each).cast("long")
        # a stretch also sees the rows that its last batch may reach
        seen = F.when((F.col("row place") % each < size) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
        parts = numbered.select(F.explode(seen).alias("stretch"), F.col("row place").alias("at"), tokens.alias("tokens"))

        def exits(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("at")
            begin = key[0] * each
            count, inside = ends(part["tokens"].to_numpy(), size, budget), min(each, len(part))
            entries = range(min(size, inside)) if begin else range(1)
            left = [begin + _walk(e, count, inside)[-1] for e in entries]
            return pd.DataFrame({"at": [begin + e for e in entries], "next": left})

        hops = aside.written(parts.groupBy("stretch").applyInPandas(exits, "at long, next long"), "hops")
        reached, jumps = aside.rounds("entries"), aside.rounds("jumps")
        entries, jump = reached.put(hops.where("at = 0").select("at")), hops
        while True:
            new = entries.join(jump, "at").select(F.col("next").alias("at")).join(entries, "at", "left_anti").join(hops.select("at"), "at", "left_semi")
            found = reached.put(entries.unionByName(new).distinct())
            jump = jumps.put(jump.alias("a").join(jump.alias("b"), F.col("a.next") == F.col("b.at")).select("a.at", "b.next"))
            entries = found
            if jump.isEmpty():
                break

        def begins(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("at")
            begin, entry = key[0] * each, part["entry"].max()
            count, inside = ends(part["tokens"].to_numpy(), size, budget), min(each, len(part))
            at = _walk(int(entry) - begin, count, inside)[:-1]
            return pd.DataFrame({"stretch": key[0], "at": [begin + a for a in at], "rows": [int(count[a]) for a in at]})

        of = entries.select(F.floor(F.col("at") / each).cast("long").alias("stretch"), F.col("at").alias("entry"))
        starts = parts.join(of, "stretch").groupBy("stretch").applyInPandas(begins, "stretch long, at long, rows long")
        starts = with_exclusive_sum(starts.withColumn("one", F.lit(1)), [F.col("at")], "one", "batch")
        member = starts.select(F.col("batch"), F.posexplode(F.sequence(F.col("at"), F.col("at") + F.col("rows") - 1)).alias("place", "row place"))
        return written(numbered.join(member, "row place").drop("row place"), "microbatches")
