"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit where over half of its 3-word shingles' hashes
have it. Fingerprints within Hamming distance 2 are linked. Covering LSH gives
every bit a nonzero vector of three bits; each of the seven nonzero vectors v
makes a table that keeps the bits whose vector has odd inner product with v.
Two differing bits put two linear conditions on v, so some v of the seven
leaves both out: every pair within the radius meets in some table.

Equal fingerprints are one row from the start. Within a table's bucket two
fingerprints differ only in bits that the table leaves out; they are within
distance 2 exactly if flipping at most one such bit in each gives the same
word. So each sends its flips and meets others there: no pairs are formed,
however large a bucket is, and no link is lost.

Cases: a null or empty text, or one of white space, has fingerprint zero, linked
like any other. Fewer than three words are one shingle. Repeated rows share a
component. A null doc_id never names a component unless all its rows are null.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.shared import table, written
from loomtrace.llm.text import LOWER, Words, slices
from loomtrace.operators.graph import components, dealt_anew

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Text whose shingles are hashed at once; a longer text is hashed whole.
SLICE_BYTES = 4 << 20


def vectors(radius: int = RADIUS) -> list[int]:
    """The vector of each of the 64 bits: 1 to 2^(radius+1) - 1 in turn."""
    n = (1 << (radius + 1)) - 1
    return [i % n + 1 for i in range(64)]


def masks(radius: int = RADIUS) -> list[int]:
    """The bits that each table keeps."""
    of = vectors(radius)
    return [sum(1 << i for i in range(64) if bin(of[i] & v).count("1") % 2) for v in range(1, 1 << (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bit_counts(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of each document's hashes have each bit; documents have hashes up to ``ends`` and one at least.

    A byte lane sums one bit of eight for up to 255 hashes at a time.
    """
    begins = np.concatenate([[0], ends[:-1]])
    n = -(-(ends - begins) // 255)
    doc = np.repeat(np.arange(len(ends)), n)
    part = begins[doc] + 255 * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
    first = np.cumsum(n) - n
    counts = np.zeros((len(ends), 64), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), part)
        counts[:, k::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first)
    return counts


def fingerprints_of(texts: pa.Array) -> np.ndarray:
    import xxhash

    words = Words(texts, LOWER)
    out = np.zeros(len(texts), np.uint64)
    if not len(words.codes):
        return out
    plain = [w.encode() for w in words.strings()]
    spaced = [w + b" " for w in plain]
    codes = words.codes.tolist()
    last = [plain[c] for c in codes]
    lead = [spaced[c] for c in codes]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b"".join, zip(lead, lead[1:], last[2:])), repeat(SEED)), np.uint64, max(0, len(codes) - 2))
    hashes = np.concatenate([hashes, np.zeros(min(2, len(codes)), np.uint64)])
    counts, begins = words.counts, words.bounds[:-1]
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE)).tolist():
        hashes[begins[i]] = xxhash.xxh64_intdigest(b" ".join(last[begins[i] : begins[i] + counts[i]]), SEED)
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    docs = np.flatnonzero(n)
    at = np.arange(len(hashes)) - np.repeat(begins, counts) < np.repeat(n, counts)
    bits = 2 * _bit_counts(hashes[at], np.cumsum(n[docs])) > n[docs][:, None]
    out[docs] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=SLICE_BYTES):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fingerprints_of(batch.column("text")).view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (64 bits as a long)."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """u, v: links that connect every pair of fingerprints (column fp, distinct) within distance 2, by the pair itself or over a fingerprint within 2 of both."""
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.lit(_signed(m)).alias("mask"), F.array(*[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]).alias("free")) for k, m in enumerate(masks())])
    rows = distinct.select("fp", F.explode(F.transform(tables, lambda x: F.struct(x["t"].alias("t"), F.col("fp").bitwiseAND(x["mask"]).alias("key")))).alias("x")).select("fp", "x.t", "x.key")
    rows = written(rows, "buckets")
    shared = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    met = rows.join(dealt_anew(shared, "key"), ["t", "key"])
    free = F.element_at(F.transform(tables, lambda x: x["free"]), F.col("t") + 1)
    flips = met.select("fp", F.explode(F.concat(F.array("fp"), F.transform(free, lambda b: F.col("fp").bitwiseXOR(b)))).alias("z")).distinct()
    flips = written(flips, "flips")
    hubs = flips.groupBy("z").agg(F.min("fp").alias("hub"), F.max("fp").alias("other")).where("hub != other").select("z", "hub")
    return flips.join(dealt_anew(hubs, "z"), "z").where("fp != hub").select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable over links) for each row."""
    rows = written(fingerprints(docs), "fingerprints")
    groups = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = written(groups, "fingerprint-groups")
    roots = components(links(groups.select("fp"))).withColumnRenamed("node", "fp")
    labelled = groups.join(roots, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    labelled = written(labelled, "labelled")
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    # a component may hold most fingerprints, and a fingerprint most rows
    of = labelled.join(dealt_anew(least, "root"), "root").select("fp", "component_id")
    return rows.join(dealt_anew(of, "fp"), "fp")


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash_components": op7_simhash_components}
SQL: dict[str, str] = {}
