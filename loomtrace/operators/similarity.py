"""Unit vectors and exact cosine pairs over a threshold, block against block.

Vectors are dealt into blocks; each unordered pair of blocks is one group whose
scores are a matrix product. A block meets every block, as an exact all-pairs
join must. Up to BLOCKS blocks of BLOCK_ROWS vectors their number is fixed and they
grow, so each vector is sent BLOCKS times, however many there are; beyond that, blocks
keep their size. A task holds two blocks, works off scores STRIP rows at a time, and
only pairs over the threshold leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors of a block at most (32 MB of 64 dimensions), blocks up to there, rows below which a block isn't cut, rows of scores at once.
BLOCK_ROWS, BLOCKS, LEAST_ROWS, STRIP = 1 << 16, 8, 1024, 256


def unit(column: str):
    v = F.transform(column, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def checked_threshold(threshold: float) -> float:
    """A similarity threshold between 0.1 and 1; raises otherwise."""
    if isinstance(threshold, bool) or not 0.1 <= threshold <= 1:
        raise ValueError("a similarity threshold is between 0.1 and 1")
    return float(threshold)


def blocks(rows: int, block_rows: int | None = None) -> int:
    """How many blocks so many vectors are dealt into."""
    return max(1, -(-rows // block_rows) if block_rows else max(min(BLOCKS, -(-rows // LEAST_ROWS)), -(-rows // BLOCK_ROWS)))


def _matrix(part: pa.Table) -> np.ndarray:
    vectors = part.column("vector").combine_chunks()
    sizes = set(vectors.value_lengths().to_pylist())
    if len(sizes) > 1:
        raise ValueError("vectors have different lengths")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def cosine_pairs(vectors: DataFrame, threshold: float, block_rows: int | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """left_id < right_id with cosine of at least ``threshold`` (columns id, vector: unit length); scores to 6 decimals.

    carried: columns of the vectors that come along, as left_<name> and right_<name>.
    """
    threshold = checked_threshold(threshold)
    n = blocks(vectors.count(), block_rows)
    rows = vectors.where("vector IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.struct(F.least("block", b).alias("a"), F.greatest("block", b).alias("b"))))
    dealt = rows.withColumn("pair", pairs).select("id", "vector", *carried, "block", "pair.a", "pair.b")
    sides = [T.StructField(f"{side}_{c}", vectors.schema[c].dataType) for c in carried for side in ("left", "right")]
    schema = T.StructType([*T.StructType.fromDDL("left_id long, right_id long").fields, *sides, T.StructField("score", T.DoubleType())])

    def score(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(list(batches))
        a, b = (x.as_py() for x in key)
        block = part.column("block").to_numpy()
        left, right = (part.take(pa.array(np.flatnonzero(block == x))) for x in (a, b))
        if not len(left) or not len(right):
            return
        x, y = _matrix(left), _matrix(right).T
        ids = [t.column("id").to_numpy() for t in (left, right)]
        for at in range(0, len(x), STRIP):
            s = x[at : at + STRIP] @ y
            i, j = np.nonzero(s >= threshold)
            s, i = s[i, j], i + at
            keep = ids[0][i] < ids[1][j] if a == b else ids[0][i] != ids[1][j]
            i, j, s = i[keep], j[keep], np.round(np.clip(s[keep], -1, 1), 6)
            p, q = ids[0][i], ids[1][j]
            swapped = pa.array(p > q)
            out = [pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))]
            for c in carried:
                u, v = left.column(c).take(pa.array(i)).combine_chunks(), right.column(c).take(pa.array(j)).combine_chunks()
                out += [pc.if_else(swapped, v, u), pc.if_else(swapped, u, v)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(s)], names=schema.names)

    # by number: adaptive execution would put all pairs of blocks into a few tasks, as they are small
    return dealt.repartition(n * (n + 1) // 2, "a", "b").groupBy("a", "b").applyInArrow(score, schema)
