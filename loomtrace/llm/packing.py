"""Best-fit packing with bound-certified repacking.

Pieces of documents are dealt into partitions at random and packed by best-fit
decreasing. Dual-feasible functions bound from below how many sequences a
partition needs. Where that many suffice and the bound before rounding leaves next
to no room, the partition is certified and settled whole. Of a partition with a
gap those sequences are settled that are certified by themselves: next to full
each, and together short of less than one. The documents of the rest are exchanged:
pooled, dealt anew and packed again, until all is certified, one partition is left,
or a round has saved next to no sequence of those it packed anew. What is settled
so may need fewer sequences: part_bins over part_bound says so.

Cases: a null or empty text is the end id alone. Longer documents are cut at
multiples of the capacity. Rows of one doc_id are packed separately. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.shared import bucketed, table, written
from loomtrace.llm.text import slices
from loomtrace.llm.tokens import SLICE_BYTES, encoder, tokenizer_path, with_end

CAPACITY, END_ID = 4096, 1
#: Pieces dealt to one partition, of which a task holds the lengths; the number of partitions grows with the input.
PIECES_EACH = 1 << 16
#: What is settled before the end has room of one in so many at most: a sequence by itself, a partition over its bound.
ROOM = 256
#: Rounds go on while they save one in so many sequences.
SAVED = 1000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; computed where the text is read."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in slices(batches, most=SLICE_BYTES):
            ids, bounds = with_end(*coder.encode(batch.column("text")), end_id)
            data = memoryview(ids.astype("<u4").tobytes())
            size = np.diff(bounds)
            n = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(size[doc] - start, capacity)
            begin = bounds[doc] + start
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], schema=_PIECE)

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


def unrounded_bound(lengths: np.ndarray, capacity: int) -> Fraction:
    """Sequences needed at least, with a fraction: the largest bound of two families of dual-feasible functions.

    u_k(x) rounds (k + 1) x to a multiple of 1/k, up only where x is not exact;
    v_e(x) counts lengths over capacity - e as whole and leaves out those under e.
    """
    if not len(lengths):
        return Fraction(0)
    x = np.asarray(lengths, np.int64)
    best = Fraction(int(x.sum()), capacity)
    for k in range(1, 21):
        scaled, exact = divmod((k + 1) * x, capacity)
        value = np.where(exact == 0, x * k, scaled * capacity)  # in units of 1 / (k * capacity)
        best = max(best, Fraction(int(value.sum()), k * capacity))
    ordered = np.sort(x)
    sums = np.concatenate([[0], np.cumsum(ordered)])
    for e in np.unique(ordered[ordered <= capacity // 2]).tolist():
        low, high = np.searchsorted(ordered, e, "left"), np.searchsorted(ordered, capacity - e, "right")
        best = max(best, int(len(ordered) - high) + Fraction(int(sums[max(high, low)] - sums[low]), capacity))
    return best


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences needed at least."""
    return math.ceil(unrounded_bound(lengths, capacity))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and how many bins. Ties fill the oldest bin."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, n = 0, 0  # bit r is set if a bin has room r
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        x = int(lengths[i])
        fits = open_rooms >> x
        if fits:
            r = x + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            r, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - r
        left = r - x
        if left:
            room[left].append(b)
            open_rooms |= 1 << left
    return bins, offsets, n


def certified(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bins to settle: all, if as many are needed and there is next to no room, else the full ones that are needed for what they hold."""
    n, least = int(bins.max()) + 1, unrounded_bound(lengths, capacity)
    if n == math.ceil(least) and ROOM * (n - least) <= n:
        return np.arange(n)
    lack = capacity - np.bincount(bins, lengths, n)
    fullest = np.argsort(lack, kind="stable")
    # their tokens alone need as many, as they lack less than a sequence together
    return fullest[(np.cumsum(lack[fullest]) < capacity) & (ROOM * lack[fullest] <= capacity)]


def _packed(round_no: int, capacity: int):
    """Places of a partition's pieces; ``settled`` are certified; bins and bound of these (part_) and of the partition (whole_)."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        lengths = part["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        stay = certified(bins, lengths, capacity)
        part = part.drop(columns=["part"])
        part["sequence_id"] = (np.int64(round_no) << 56) + (np.int64(key[0]) << 24) + bins
        part["offset"] = offsets
        part["part_bins"] = part["part_bound"] = len(stay)
        part["whole_bins"], part["whole_bound"] = n, lower_bound(lengths, capacity)
        part["settled"] = np.isin(bins, stay)
        return part

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, pieces_each: int = PIECES_EACH) -> DataFrame:
    """Add sequence_id and offset to rows with ``length`` of at most ``capacity``, and how many sequences were settled with it (part_bins) and are needed at least for their pieces (part_bound).

    The two are equal but for partitions that the last round leaves with a gap.
    """
    names = items.columns
    schema = items.schema
    added = ["sequence_id", "offset", "part_bins", "part_bound"]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", sequence_id long, offset long, part_bins long, part_bound long, whole_bins long, whole_bound long, settled boolean"
    left, n, k, before, settled = items, items.count(), 0, None, None
    while True:
        parts = bucketed(n, pieces_each)
        # a number of its own for each row deals equal rows apart
        dealt = left.select(*names, F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(k)), F.lit(parts)).alias("part"))
        done = written(dealt.groupBy("part").applyInPandas(_packed(k, capacity), out), "packed")
        unsettled = F.when(~F.col("settled"), F.col("sequence_id"))
        bins, rest, n = done.agg(F.count_distinct("sequence_id"), F.count_distinct(unsettled), F.count(unsettled)).first()
        last = parts == 1 or not n or (before is not None and SAVED * (before - bins) < before)
        if last:
            this = done.select(*names, "sequence_id", "offset", F.col("whole_bins").alias("part_bins"), F.col("whole_bound").alias("part_bound"))
        else:
            this = done.where("settled").select(*names, *added)
        settled = this if settled is None else settled.unionByName(this)
        if last:
            return settled
        left, before, k = done.where("NOT settled").select(*names), rest, k + 1


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(written(pieces(table(spark, sf_dir, "documents")), "pieces"))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
SQL: dict[str, str] = {}
