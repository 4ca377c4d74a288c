"""Near copies by the similarity of word shingles: SimHash and MinHash bands find candidates, exact Jaccard decides.

A text is the set of its distinct 5-word shingles, as 64-bit hashes. Two texts are
linked if their sets' Jaccard similarity is 0.8 at least. Each set has a SimHash
fingerprint, and covering LSH finds those within two bits (``simhash.links``): sets of
one fingerprint are compared with the least of them, and the least ones of linked
fingerprints with each other. Covering can't search so far as 0.8: such copies differ
in ten bits and more, which takes thousands of tables. So bands of minima find what
is left: of 80 minima in 20 bands of four, a pair at 0.8 shares no band with
probability (1 - 0.8^4)^20 < 0.00003.

Equal sets are one row from the start. In each bucket every set is compared with
the least one; then, where a bucket still holds several components, all pairs of
different components in it. Buckets of over 32 sets do the second in random blocks
of about four, anew in each band, so pairs grow with a bucket and not with its
square. What is still in several components there is joined exactly, by prefixes:
shingles are ordered by how many of these sets have them, rarest first (any order
that is the same for all sets is right, so those of one of PLACES places count
together), and of two sets similar enough the larger has one of the smaller's first ninth among its own
first fifth. Sizes and the places of the shingle that two sets meet at leave out
pairs that can't be similar, a hot shingle is split by the join, and pairs within a
component aren't formed. So only what no band puts together is missed. Very many
texts of which any two are near the bound stay as many pairs as they are.

Cases: a null or empty text, or one of white space, has the empty set, which is
linked to itself alone. Fewer than five words are one shingle. Repeated rows share
a component. A null doc_id never names a component unless all its rows are null.
Rows equal in doc_id and text are one document (``keyed``). A very long text is one
set of all its shingles, hashed whole. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.line_dedup import keyed
from loomtrace.llm.shared import written
from loomtrace.llm.simhash import SLICE_BYTES, _bit_counts, links
from loomtrace.llm.text import LOWER, Words, slices
from loomtrace.operators.graph import components, dealt_anew

SHINGLE, SEED = 5, 42
BANDS, EACH = 20, 4
#: Linked from this share on, as a fraction.
SIMILAR = (4, 5)
#: Sets of a bucket of which all pairs are compared; larger buckets are dealt in blocks of about BLOCK.
WHOLE, BLOCK = 32, 4
#: Counts of shingles that the order of prefixes goes by; 2 MB sent to all tasks. They are added up in shelves.
PLACES, SHELF = 1 << 18, 1 << 10


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each text's begin and end."""
    import xxhash

    words = Words(texts, LOWER)
    plain = [w.encode() for w in words.strings()]
    codes, bounds = words.codes.tolist(), words.bounds.tolist()
    sets = []
    for a, b in zip(bounds, bounds[1:]):
        own = [plain[c] for c in codes[a:b]]
        own = {b" ".join(own)} if 0 < len(own) < SHINGLE else set(map(b" ".join, zip(*(own[k:] for k in range(SHINGLE)))))
        sets.append(np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in own), np.uint64, len(own))))
    ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    return np.concatenate([np.zeros(0, np.uint64), *sets]), ends


def _set_ids(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    import xxhash

    bounds = ends.tolist()
    return np.array([xxhash.xxh64_intdigest(hashes[a:b].tobytes(), SEED) for a, b in zip(bounds, bounds[1:])], np.uint64)


def band_keys(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """BANDS keys of each set; sets must not be empty."""
    rng = np.random.default_rng(SEED)
    keys = np.zeros((len(ends) - 1, BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(ends) - 1, band + 1, np.uint64)
        for _ in range(EACH):
            a, b = rng.integers(0, 1 << 64, 2, np.uint64)
            least = np.minimum.reduceat(hashes * (a | np.uint64(1)) + b, ends[:-1])
            key = (key ^ least) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    return keys


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=SLICE_BYTES):
        hashes, ends = shingle_sets(batch.column("text"))
        full = np.flatnonzero(np.diff(ends))
        keys = band_keys(hashes, np.concatenate([ends[:-1][full], ends[-1:]])) if len(full) else np.zeros((0, BANDS), np.uint64)
        fps = np.zeros(len(ends) - 1, np.uint64)
        if len(full):
            bits = 2 * _bit_counts(hashes, ends[1:][full]) > np.diff(ends)[full][:, None]
            fps[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
        offsets = np.concatenate([[0], np.cumsum((np.diff(ends) > 0) * BANDS)]).astype(np.int32)
        keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "id", "text_key")), pa.array(_set_ids(hashes, ends).view(np.int64)), pa.array(fps.view(np.int64)), keys], ["doc_id", "id", "text_key", "set_id", "fp", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=SLICE_BYTES):
        hashes, ends = shingle_sets(batch.column("text"))
        sets = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64))).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(_set_ids(hashes, ends).view(np.int64)), sets], ["set_id", "hashes"])


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (columns u, v) whose sets are similar."""
    u, v = sets.toDF("u", "u_hashes"), sets.toDF("v", "v_hashes")
    both = F.size(F.array_intersect("u_hashes", "v_hashes"))
    met = pairs.join(u, "u").join(v, "v").withColumn("both", both)
    share, of = SIMILAR
    return met.where(of * F.col("both") >= share * (F.size("u_hashes") + F.size("v_hashes") - F.col("both"))).select("u", "v")


def fingerprint_pairs(marks: DataFrame) -> DataFrame:
    """u > v of sets (set_id, fp): each with the least of its fingerprint, and the least ones of fingerprints within two bits."""
    marks = written(marks.distinct(), "marks")
    least = written(marks.groupBy("fp").agg(F.min("set_id").alias("hub")), "fingerprints")
    same = marks.join(dealt_anew(least, "fp"), "fp").where("set_id != hub").select(F.col("set_id").alias("u"), F.col("hub").alias("v"))
    near = links(least.select("fp")).toDF("a", "b").join(least.toDF("a", "u"), "a").join(least.toDF("b", "v"), "b")
    return same.unionByName(near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))).distinct()


def _prefixes(often: np.ndarray):
    """Shingles of sets (set_id, root, hashes) that come first by how often they are, less those of one set alone."""
    share, of = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, rows = batch.column("hashes"), []
            for k in range(len(batch)):
                h = hashes[k].values.to_numpy()
                n, size = often[h % PLACES], len(h)
                first = np.lexsort((h, n))[: size - -(-share * size // of) + 1]
                at = np.flatnonzero(n[first] > 1)
                rows.append((np.full(len(at), k), np.full(len(at), size), at, h[first[at]]))
            k, size, at, h = (np.concatenate(x) for x in zip(*rows)) if rows else np.zeros((4, 0), np.int64)
            index = size - -(-2 * share * size // (share + of)) + 1
            own = (batch.column(c).take(pa.array(k)) for c in ("set_id", "root"))
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(x) for x in (size, index, at, h))], ["set_id", "root", "size", "index", "at", "h"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task's sets hold, by place: a row for each shelf that they meet."""
    counts = np.zeros(PLACES, np.int64)
    for batch in batches:
        counts += np.bincount(batch.column("hashes").flatten().to_numpy() % PLACES, minlength=PLACES)
    at = np.flatnonzero(counts)
    shelves, first = np.unique(at // SHELF, return_index=True)
    ends = pa.array(np.append(first, len(at)).astype(np.int32))
    yield pa.RecordBatch.from_arrays([pa.array(shelves), pa.ListArray.from_arrays(ends, pa.array(at % SHELF)), pa.ListArray.from_arrays(ends, pa.array(counts[at]))], ["shelf", "at", "n"])


def _added(found: pa.Table) -> pa.Table:
    counts = np.zeros(SHELF, np.int64)
    for at, n in zip(found.column("at").chunks, found.column("n").chunks):
        np.add.at(counts, at.flatten().to_numpy(), n.flatten().to_numpy())
    return pa.table({"shelf": found.column("shelf")[:1], "n": pa.array([counts], pa.list_(pa.int64()))})


def shelf_counts(own: DataFrame) -> DataFrame:
    """shelf, n (array): how many shingles of all sets (hashes) have each of a shelf's places. Tasks count their own sets, so no row is made for a shingle."""
    return own.select("hashes").mapInArrow(_counted, "shelf long, at array<long>, n array<long>").groupBy("shelf").applyInArrow(_added, "shelf long, n array<long>")


def prefix_pairs(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v: every pair of sets of ``crowd`` (set_id, root) of different roots that may be similar. ``sets``: set_id, hashes."""
    share, of = SIMILAR
    own = crowd.join(sets, "set_id").select("set_id", "root", "hashes")
    often = np.zeros((PLACES // SHELF, SHELF), np.int64)
    for row in shelf_counts(own).collect():
        often[row["shelf"]] = row["n"]
    often = often.ravel()
    rows = written(own.mapInArrow(_prefixes(often), "set_id long, root long, size long, index long, at long, h long"), "prefixes")
    x = rows.select("h", F.col("set_id").alias("u"), F.col("root").alias("u_root"), F.col("size").alias("u_size"), F.col("at").alias("u_at"))
    y = rows.where(F.col("at") < F.col("index")).select("h", F.col("set_id").alias("v"), F.col("root").alias("v_root"), F.col("size").alias("v_size"), F.col("at").alias("v_at"))
    smaller = "u_root != v_root AND (v_size < u_size OR (v_size = u_size AND v < u))"
    near = f"{of} * v_size >= {share} * u_size AND {share + of} * least(u_size - u_at, v_size - v_at) >= {share} * (u_size + v_size)"
    return x.join(y, "h").where(f"{smaller} AND {near}").select("u", "v").distinct()


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components (set_id, component; a least set has no row) with further links (u, v): only components that a link joins are gone through again."""
    of = lambda c: roots.select(F.col("set_id").alias(c), F.col("component").alias(f"{c}_root"))
    ends = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))
    moved = components(ends).select(F.col("node").alias("root"), F.col("component").alias("to"))
    old = roots.join(dealt_anew(moved.withColumnRenamed("root", "component"), "component"), "component", "left").select("set_id", F.coalesce("to", "component").alias("component"))
    return written(old.unionByName(moved.select(F.col("root").alias("set_id"), F.col("to").alias("component"))), "roots")


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, id, text_key, set_id), sets (set_id, root), and the least document (unknown, id, text_key) of each root."""
    texts = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = written(texts.select("doc_id", "id", "text_key", "text").mapInArrow(_bands, "doc_id long, id long, text_key long, set_id long, fp long, keys array<long>"), "bands")
    document = F.struct(F.col("doc_id").isNull().alias("unknown"), "id", "text_key")
    groups = written(rows.groupBy("set_id").agg(F.min(document).alias("least")), "set-groups")
    # equal sets have equal keys: distinct combines them before the shuffle
    buckets = written(rows.select("set_id", F.explode("keys").alias("key")).distinct(), "buckets")
    shared = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("set_id").alias("hub")).where("n > 1")
    met = written(buckets.join(dealt_anew(shared, "key"), "key").select("key", "n", "hub", "set_id"), "met")

    prints = written(fingerprint_pairs(rows.where("size(keys) > 0").select("set_id", "fp")), "fingerprint-pairs")
    wanted = met.select("set_id").unionByName(prints.select(F.inline(F.array(F.struct(F.col("u").alias("set_id")), F.struct(F.col("v").alias("set_id"))))))

    of = groups.join(wanted.distinct(), "set_id", "left_semi").select("least.id", "least.text_key").distinct()
    # hashed, not sorted: the texts only pass by
    texts = texts.join(of.hint("shuffle_hash"), ["id", "text_key"], "left_semi").select("text")
    sets = written(texts.mapInArrow(_sets, "set_id long, hashes array<long>").dropDuplicates(["set_id"]), "sets")

    first = written(met.where("set_id != hub").select(F.col("set_id").alias("u"), F.col("hub").alias("v")).unionByName(prints).distinct(), "pairs")
    roots = components(written(_similar(first, sets), "links")).withColumnRenamed("node", "set_id")
    wide = written(met.where("n > 2").join(roots, "set_id", "left").select("key", "n", "set_id", F.coalesce("component", "set_id").alias("root")), "wide")
    open_keys = wide.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    block = F.when(F.col("n") <= WHOLE, F.lit(0)).otherwise(F.pmod(F.xxhash64("set_id", "key"), F.ceil(F.col("n") / BLOCK)))
    wide = written(wide.join(dealt_anew(open_keys, "key"), "key").select("key", block.cast("long").alias("block"), "set_id", "root"), "blocks")
    u, v = wide.toDF("key", "block", "u", "u_root"), wide.toDF("key", "block", "v", "v_root")
    second = u.join(v, ["key", "block"]).where("u > v AND u_root != v_root").select("u", "v").distinct()
    roots = _joined(roots, written(_similar(written(second.join(first, ["u", "v"], "left_anti"), "pairs"), sets), "links"))

    crowd = met.where(F.col("n") > WHOLE).select("key", "set_id").join(dealt_anew(roots, "set_id"), "set_id", "left").select("key", "set_id", F.coalesce("component", "set_id").alias("root"))
    crowd = written(crowd, "crowd")
    open_keys = crowd.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    crowd = written(crowd.join(dealt_anew(open_keys, "key"), "key", "left_semi").select("set_id", "root").distinct(), "crowd")
    if not crowd.isEmpty():
        roots = _joined(roots, written(_similar(written(prefix_pairs(crowd, sets), "pairs"), sets), "links"))
    labelled = written(groups.join(roots, "set_id", "left").select("set_id", "least", F.coalesce("component", "set_id").alias("root")), "labelled")
    least = labelled.groupBy("root").agg(F.min("least").alias("least"))
    return rows, labelled.select("set_id", "root"), least


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, set_id, component_id (the least doc_id reachable over links) for each row."""
    rows, labelled, least = _labelled(docs)
    of = F.when(~F.col("least.unknown"), F.col("least.id")).alias("component_id")
    found = labelled.join(dealt_anew(least, "root"), "root").select("set_id", of)
    return rows.select("doc_id", "set_id").join(dealt_anew(found, "set_id"), "set_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` and one row of each component: of the least doc_id, then the least text_key."""
    stay = _labelled(docs)[2].select("least.id", "least.text_key")
    return keyed(docs).join(stay, ["id", "text_key"], "left_semi").dropDuplicates(["id", "text_key"]).select(*[F.col(f"`{c}`") for c in docs.columns])
