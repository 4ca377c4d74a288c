"""Toxicity: FTRL-proximal logistic regression over hashed word features.

Features of a text are the hashed words, adjacent pairs and pairs with one word
between them that it has, and the stems (first ``STEM`` letters) of longer words,
so that an inflected form not met in training still counts. Every coordinate has its
own learning rate; the L1 term leaves most weights at zero, so the model is a short
list of (bucket, weight).

Features of the labelled rows are found once and written. Training is by rounds of
parameter mixing: each of a few shards runs FTRL over its rows from the mixed state
and sends how its coordinates changed, in blocks. Each coordinate moves by the mean
of the shards that met it, so one known to a single shard learns as fast as with one
shard in all. The blocks' means, 8 MB in all, come to the driver; the state has as
many coordinates as buckets, whatever the input's size.

Labelled rows: at most about ``SAMPLE_ROWS`` (a share of ids by hash once there
are more, and of distinct rows where ids repeat), a documented bound; the corpus is
scored whole.

Cases: a null, empty or white text scores by the bias alone. Rows without a
label, or whose label isn't 0 or 1, aren't learned from. With no labelled rows
every score is 0. Repeated rows score alike. A very long text is scored whole and
learned whole. Other columns pass through ``score``, but for one of its own name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.shared import added, bucketed, crc_remainder, held_out, table, without, written
from loomtrace.llm.text import LOWER, Words, slices

BUCKET_BITS = 20
#: Blocks that a state is sent in.
BLOCKS = 64
SAMPLE_ROWS = 40_000
#: Rows of a shard (at most SHARDS of them) and rounds.
SHARD_ROWS, SHARDS, ROUNDS = 8000, 8, 5
#: FTRL's alpha, beta and the strengths of L1 and L2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.0
THRESHOLD = 0.7
#: Text scored at once; a longer text is scored whole.
SLICE_BYTES = 4 << 20
STEM = 4
_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BIAS = 0  # the bucket that every text has


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return ((x ^ (x >> np.uint64(27))) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Document and bucket of each feature occurrence in a slice (the bias apart), a family at a time: words, stems, pairs, skips."""
    import xxhash

    words = Words(texts, LOWER)
    bare = [w.strip(_STRIP) for w in words.strings()]
    codes, doc = words.codes, np.repeat(np.arange(len(words.counts), dtype=np.int32), words.counts)
    of_word = np.fromiter((xxhash.xxh64_intdigest(w) for w in bare), np.uint64, len(bare))
    yield doc, _mixed(of_word)[codes]
    of_stem = np.fromiter((xxhash.xxh64_intdigest(w[:STEM], 1) if len(w) > STEM else 0 for w in bare), np.uint64, len(bare))
    longer = (of_stem != 0)[codes]
    yield doc[longer], _mixed(of_stem)[codes[longer]]
    for gap, salt in ((1, _PAIR), (2, _SKIP)):
        if len(codes) > gap:
            same = np.flatnonzero(doc[gap:] == doc[:-gap])
            yield doc[same], _mixed(of_word[codes[same]] * salt + (of_word[codes[same + gap]] << np.uint64(1)) + np.uint64(gap))


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl(rows: Iterable[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass over (buckets, label) rows; changes z and n."""
    for at, label in rows:
        za, na = z[at], n[at]
        w = _weights(za, na)
        p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        root = np.sqrt(na + g * g)
        z[at] = za + g - (root - np.sqrt(na)) / ALPHA * w
        n[at] = na + g * g


def _rows(texts: pa.Array, labels: list[int]) -> list[tuple[np.ndarray, int]]:
    key = np.unique(np.concatenate([(doc.astype(np.int64) << BUCKET_BITS) | bucket for doc, bucket in features(texts)]))
    doc, bucket = key >> BUCKET_BITS, (key & ((1 << BUCKET_BITS) - 1)).astype(np.int32)
    edges = np.searchsorted(doc, np.arange(len(labels) + 1))
    return [(np.union1d(bucket[edges[i] : edges[i + 1]], [BIAS]), y) for i, y in enumerate(labels)]


def packed(buckets: np.ndarray) -> bytes:
    """Ascending buckets as steps of 16 bits; a step of 65,535 is only part of the next."""
    step = np.diff(buckets, prepend=0)
    ends = np.cumsum(step // 65535 + 1)
    out = np.full(ends[-1] if len(ends) else 0, 65535, "<u2")
    out[ends - 1] = step % 65535
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    step = np.frombuffer(data, "<u2")
    return np.cumsum(step, dtype=np.int64)[step != 65535]


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What training needs of texts, found once: their buckets."""
    for batch in slices(batches, most=SLICE_BYTES):
        buckets = pa.array([packed(at) for at, _ in _rows(batch.column("text"), batch.column("label").to_pylist())], pa.binary())
        yield pa.RecordBatch.from_arrays([buckets, batch.column("label").cast(pa.int32()), batch.column("shard")], ["buckets", "label", "shard"])


def _shard(state: Broadcast):
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        import xxhash

        z, n = (x.astype(np.float64) for x in state.value)
        # by what they are, as rows come in any order
        part = part.iloc[np.lexsort(([xxhash.xxh64_intdigest(x) for x in part["buckets"]], part["label"]))]
        order = np.random.default_rng(len(part) + key[0]).permutation(len(part))
        buckets, labels = part["buckets"].to_numpy()[order], part["label"].to_numpy()[order]
        ftrl(((unpacked(x), y) for x, y in zip(buckets, labels.tolist())), z, n)
        moved = np.stack([z - state.value[0], n - state.value[1]], 1).astype("<f4").reshape(BLOCKS, -1)
        return pd.DataFrame({"block": np.arange(BLOCKS), "moved": [x.tobytes() for x in moved]})

    return run


def _averaged(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """A block's changes: of each coordinate the mean over the shards that met it, one row a shard."""
    total, met = 0.0, 0
    for x in part["moved"]:
        change = np.frombuffer(x, "<f4").reshape(-1, 2)
        total, met = total + change, met + (change[:, 1:] != 0)
    return pd.DataFrame({"block": [key[0]], "moved": [(total / np.maximum(met, 1)).astype("<f4").tobytes()]})


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """text, label, shard of at most about ``most`` distinct labelled rows, chosen by a hash of the id, and of id and text where ids repeat.

    Only the chosen ids, bounded by ``most``, meet the texts.
    """
    labels = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    labels = labels.where(crc_remainder("doc_id") != 1)
    n = labels.count()
    if n > most:
        labels = labels.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * most / n))
    rows = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")
    n = rows.count()
    if n > most:
        key = F.xxhash64("doc_id", "text", F.lit(7))
        n = rows.select(F.approx_count_distinct(key, 0.02)).first()[0]
        rows = rows.where(F.pmod(key, F.lit(1 << 20)) < int((1 << 20) * min(1.0, most / n))).distinct()
    shards = min(SHARDS, bucketed(min(n, most), SHARD_ROWS))
    return rows.select("text", "label", F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(shards)).cast("int").alias("shard"))


def fit(sample: DataFrame, rounds: int = ROUNDS) -> pd.DataFrame:
    """The model: bucket, weight of every nonzero weight (at most 2 ** BUCKET_BITS rows)."""
    sample = written(sample.mapInArrow(_bucketed, "buckets binary, label int, shard int"), "toxicity-sample")
    shards = sample.agg(F.count_distinct("shard")).first()[0]
    z, n = np.zeros(1 << BUCKET_BITS, np.float32), np.zeros(1 << BUCKET_BITS, np.float32)
    for _ in range(rounds if shards else 0):
        state = sample.sparkSession.sparkContext.broadcast((z, n))  # of the model's fixed size
        moved = sample.groupBy("shard").applyInPandas(_shard(state), "block int, moved binary")
        moved = moved.groupBy("block").applyInPandas(_averaged, "block int, moved binary").collect()  # of the model's fixed size
        change = np.frombuffer(b"".join(bytes(r.moved) for r in sorted(moved, key=lambda r: r.block)), "<f4").reshape(-1, 2)
        z, n = z + change[:, 0], n + change[:, 1]
        state.unpersist()
    z, n = z.astype(np.float64), n.astype(np.float64)
    at = np.flatnonzero(np.abs(z) > L1)
    return pd.DataFrame({"bucket": at, "weight": _weights(z[at], n[at])})


def score(docs: DataFrame, model: pd.DataFrame) -> DataFrame:
    """The columns of ``docs`` and ``score``."""
    buckets, weights = model["bucket"].to_numpy(np.int64), model["weight"].to_numpy()
    docs = without(docs, {"score"})
    if not len(buckets):
        return docs.withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast((buckets, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BUCKET_BITS)
        dense[shared.value[0]] = shared.value[1]
        weighs = dense != 0
        for batch in slices(batches, most=SLICE_BYTES):
            keys = []
            for doc, bucket in features(batch.column("text")):
                some = np.flatnonzero(weighs[bucket])
                keys.append((doc[some].astype(np.int64) << BUCKET_BITS) | bucket[some])
            key = np.unique(np.concatenate(keys))
            w = np.bincount(key >> BUCKET_BITS, dense[key & ((1 << BUCKET_BITS) - 1)], batch.num_rows) + dense[BIAS]
            p = 1.0 / (1.0 + np.exp(-np.clip(w, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, added(docs, "score double"))


def trained(spark: SparkSession, sf_dir: str) -> pd.DataFrame:
    return fit(labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op5_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents").select("doc_id", "text"), trained(spark, sf_dir))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op5_ftrl_toxicity": op5_ftrl_toxicity}
SQL: dict[str, str] = {}
