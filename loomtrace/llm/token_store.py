"""Token-ID output: a content-addressed store of id streams.

A rolling hash over ids cuts each document's stream into chunks, so equal
passages give equal chunks. A chunk's address is the hash of its bytes; each is
stored once. A document's recipe lists its chunks; recipes lie in ascending
doc_id order with the ids before each. A Merkle tree over recipes ends in one
root, the manifest's. Reading takes every chunk, recomputes its address, each
document's root and from these the whole tree, and fails if one of them differs
from what the recipes and the manifest say.

Layout under the store's path, all Parquet:
    parts/kind=chunk/    address, width (bytes an id), ids (little-endian)
    recipes/             doc_id, start, n_tokens, addresses, root
    manifest/            level, node, root

Cases: a null or empty text has the end id alone. A null doc_id sorts first.
Rows of one doc_id stay separate, ordered by their length, then by their root;
only equal texts tie, and these are alike. An empty table gives an empty store.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.shared import new_path, table, written
from loomtrace.llm.text import slices
from loomtrace.llm.tokens import SLICE_BYTES, encoder, tokenizer_path, with_end
from loomtrace.operators.ordering import with_exclusive_sum
from loomtrace.sources.storage import removed

END_ID = 1
#: Cuts fall on about one id in 256, at least 64 and at most 1,024 ids apart.
CUT_BITS, LEAST, MOST, WINDOW = 8, 64, 1024, 8
#: Chunk addresses that a task remembers so as to send a chunk once; a repeat sent again is dropped later.
SEEN = 200_000
#: Leaves of the tree are blocks of so many bits of a document's start, higher nodes of so many children's.
LEAF_BITS, NODE_BITS = 12, 10

#: Rows of chunks, and of recipes as encoded (row: a number of its own); what the other kind has is null.
_PARTS = "kind string, row long, address binary, width int, ids binary, doc_id long, n_tokens long, addresses array<binary>, root binary"
_ARROW = pa.schema([("kind", pa.string()), ("row", pa.int64()), ("address", pa.binary()), ("width", pa.int32()), ("ids", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("addresses", pa.list_(pa.binary())), ("root", pa.binary())])


def address_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary tree over the leaves in order; an odd node goes up as it is."""
    level = leaves or [b""]
    while len(level) > 1:
        pairs = [address_of(level[i] + level[i + 1]) for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


def _gear(size: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**64, size, dtype=np.uint64)


def cut_candidates(ids: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last WINDOW ids allows a cut."""
    g = gear[ids % len(gear)]
    h, k = g, 1
    while k < WINDOW:  # sums over 2, 4, 8 ids, each from two of half the width
        wider = h.copy()
        wider[k:] += h[:-k] << np.uint64(k)
        h, k = wider, 2 * k
    return np.flatnonzero((h >> np.uint64(64 - CUT_BITS)) == 0) + 1


def cuts(begin: int, end: int, candidates: list[int]) -> list[int]:
    """Ends of the chunks of one document; candidates lie within it in ascending order."""
    out, at = [], begin
    for c in candidates:
        if c - begin < WINDOW:
            continue  # its window reaches into another document
        while c - at > MOST:
            at += MOST
            out.append(at)
        if c - at >= LEAST and c < end:
            out.append(c)
            at = c
    while end - at > MOST:
        at += MOST
        out.append(at)
    out.append(end)
    return out


def _rows(kind: str, n: int, **columns: pa.Array) -> pa.RecordBatch:
    found = {"kind": pa.array([kind] * n, pa.string()), **columns}
    return pa.RecordBatch.from_arrays([found.get(f.name, pa.nulls(n, f.type)) for f in _ARROW], schema=_ARROW)


def _encoded(path: str, end_id: int):
    """Chunks that this task hasn't sent lately, and a recipe a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, gear, seen = encoder(path), _gear(1 << 16), set()
        width = 2 if max(coder.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        row = TaskContext.get().partitionId() << 36
        for batch in slices(batches, most=SLICE_BYTES):
            ids, bounds = with_end(*coder.encode(batch.column("text")), end_id)
            data = ids.astype(f"<u{width}").tobytes()
            candidates = cut_candidates(ids, gear)
            within = np.searchsorted(candidates, bounds, "right")
            candidates = candidates.tolist()
            chunks, sent, recipes, roots = [], [], [], []
            edges = bounds.tolist()
            for i in range(batch.num_rows):
                a, addresses = edges[i], []
                for b in cuts(a, edges[i + 1], candidates[within[i] : within[i + 1]]):
                    part = data[a * width : b * width]
                    addresses.append(key := address_of(part))
                    if key not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        chunks.append(key)
                        sent.append(part)
                    a = b
                recipes.append(addresses)
                roots.append(merkle_root(addresses))
            n, m = len(chunks), batch.num_rows
            yield _rows("chunk", n, address=pa.array(chunks, pa.binary()), width=pa.array(np.full(n, width, np.int32)), ids=pa.array(sent, pa.binary()))
            yield _rows("recipe", m, row=pa.array(row + np.arange(m)), doc_id=batch.column("doc_id").cast(pa.int64()), n_tokens=pa.array(np.diff(bounds)), addresses=pa.array(recipes, pa.list_(pa.binary())), root=pa.array(roots, pa.binary()))
            row += m

    return run


def _tree(leaves: DataFrame) -> DataFrame:
    """Merkle nodes of every level over rows (start, root); a node's digest is over its children in order.

    Starts are distinct, so a node has at most 2 ** LEAF_BITS children, whatever ids repeat.
    """
    last = leaves.agg(F.max("start")).first()[0] or 0
    levels = 1 + -(-max(0, int(last).bit_length() - LEAF_BITS) // NODE_BITS)
    rows = leaves.select(F.shiftright("start", LEAF_BITS).alias("node"), F.struct("start", F.hex("root").alias("root")).alias("child"))
    out = None
    for level in range(1, levels + 1):
        own = rows.groupBy("node").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("child")), lambda x: x["root"]), ","), 256).alias("root"))
        named = own.select(F.lit(level).alias("level"), "node", "root")
        out = named if out is None else out.unionByName(named)
        rows = own.select(F.shiftright("node", NODE_BITS).alias("up"), F.struct("node", "root").alias("child")).withColumnRenamed("up", "node")
    return out


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> str:
    """Encode every text, write the store under ``path`` and return the path. Texts are read and encoded once."""
    spark = docs.sparkSession
    # one shuffle brings chunks of an address together; recipes, small beside them, go along
    parts = docs.select("doc_id", "text").mapInArrow(_encoded(tokenizer or tokenizer_path(), end_id), _PARTS)
    key = ["kind", "address", "row"]
    parts.repartition(*key).dropDuplicates(key).write.partitionBy("kind").parquet(f"{path}/parts")
    recipes = spark.read.schema(_PARTS).parquet(f"{path}/parts").where("kind = 'recipe'").select("row", "doc_id", "n_tokens", "addresses", "root")
    order = [F.col("doc_id").asc_nulls_first(), F.col("n_tokens"), F.col("root"), F.col("row")]
    recipes = with_exclusive_sum(recipes, order, "n_tokens", "start").select("doc_id", "start", "n_tokens", "addresses", "root")
    recipes.repartitionByRange("start").sortWithinPartitions("start").write.parquet(f"{path}/recipes")
    removed(spark, f"{path}/parts/kind=recipe")
    _tree(_recipes(spark, path)).write.parquet(f"{path}/manifest")
    return path


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, start long, n_tokens long, addresses array<binary>, root binary").parquet(f"{path}/recipes")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_PARTS).parquet(f"{path}/parts").where("kind = 'chunk'").select("address", "width", "ids")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk: its length, the crc32 of its ids in 32 bits, and whether its bytes have its address."""
    for batch in batches:
        length, crc, sound = [], [], []
        for key, width, data in zip(*(batch.column(n).to_pylist() for n in ("address", "width", "ids"))):
            length.append(len(data) // width)
            crc.append(zlib.crc32(np.frombuffer(data, f"<u{width}").astype("<u4")))
            sound.append(address_of(data) == key)
        yield pa.RecordBatch.from_arrays([batch.column("address"), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(sound, pa.bool_())], ["address", "length", "crc", "sound"])


#: crc32's generator polynomial, bits reversed (a fixed value).
_POLYNOMIAL = 0xEDB88320


def _times(matrix: list[int], v: int) -> int:
    out = 0
    for row in matrix:
        if not v:
            break
        if v & 1:
            out ^= row
        v >>= 1
    return out


_ZEROS: dict[int, list[int]] = {}


def _zeros(n_bytes: int) -> list[int]:
    """The linear map on a crc32 register that ``n_bytes`` zero bytes make."""
    if n_bytes not in _ZEROS:
        if n_bytes == 0:
            _ZEROS[0] = [1 << i for i in range(32)]
        elif n_bytes == 1:
            bit = [_POLYNOMIAL] + [1 << i for i in range(31)]
            byte = bit
            for _ in range(7):
                byte = [_times(bit, r) for r in byte]
            _ZEROS[1] = byte
        else:
            half = _zeros(n_bytes // 2)
            twice = [_times(half, r) for r in half]
            _ZEROS[n_bytes] = [_times(_zeros(1), r) for r in twice] if n_bytes % 2 else twice
    return _ZEROS[n_bytes]


def crc_joined(first: int, second: int, second_bytes: int) -> int:
    """crc32 of two strings one after the other, from theirs and the second's length."""
    return _times(_zeros(second_bytes), first) ^ second


def _joined(crc: np.ndarray, length: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The crc32 of each document from its chunks': the k-th chunk of all documents at a time."""
    sizes, of = np.unique(length, return_inverse=True)
    maps = np.array([_zeros(4 * n) for n in sizes.tolist()], np.uint32).reshape(-1, 32)
    out = np.zeros(len(begins), np.uint32)
    for k in range(int(counts.max(initial=0))):
        docs = np.flatnonzero(counts > k)
        at = begins[docs] + k
        before, after = out[docs], crc[at].astype(np.uint32)
        for bit in range(32):
            after ^= np.where(before >> np.uint32(bit) & np.uint32(1), maps[of[at], bit], np.uint32(0))
        out[docs] = after
    return out


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, start, n_tokens, ids_crc32, root (of the chunks as they are) and verified of documents with parts."""
    for batch in batches:
        parts = batch.column("parts")
        counts = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.cumsum(counts) - counts
        flat = parts.flatten()
        length, crc = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("length", "crc"))
        address = flat.field("address").to_pylist()
        total = np.concatenate([[0], np.cumsum(length)])
        n = total[begins + counts] - total[begins]
        roots = [merkle_root(address[a : a + c]) for a, c in zip(begins.tolist(), counts.tolist())]
        sound = [s and r == w and k == m for s, r, w, k, m in zip(batch.column("sound").to_pylist(), roots, batch.column("root").to_pylist(), n.tolist(), batch.column("n_tokens").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(n), pa.array(_joined(crc, length, begins, counts).astype(np.int64)), pa.array(roots, pa.binary()), pa.array(sound, pa.bool_())], ["doc_id", "start", "n_tokens", "ids_crc32", "root", "verified"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids_crc32, root, verified.

    Every chunk is read and its address recomputed; a document's crc is joined from
    its chunks' crcs in recipe order, so no ids are shuffled. ``verified``: its
    addresses and root hold and lengths add up.
    """
    found = _chunks(spark, path).mapInArrow(_digests, "address binary, length long, crc long, sound boolean")
    refs = _recipes(spark, path).select("doc_id", "start", "n_tokens", "root", F.posexplode("addresses").alias("pos", "address"))
    met = refs.join(found, "address", "left").withColumns({"sound": F.coalesce("sound", F.lit(False)), "length": F.coalesce("length", F.lit(0)), "crc": F.coalesce("crc", F.lit(0))})
    docs = met.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.sort_array(F.collect_list(F.struct("pos", "length", "crc", "address"))).alias("parts"), F.min("sound").alias("sound"))
    return docs.mapInArrow(_assembled, "doc_id long, start long, n_tokens long, ids_crc32 long, root binary, verified boolean")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document; raises if a chunk, a recipe or the manifest doesn't hold."""
    docs = written(digests(spark, path), "token-digests")
    if wrong := docs.where("NOT verified").count():
        raise ValueError(f"{wrong} documents of {path} differ from their recipes")
    if not manifest_holds(spark, path, docs):
        raise ValueError(f"documents of {path} differ from its manifest")
    return docs.select("doc_id", "start", "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The id streams themselves: doc_id, start, ids array<int>."""

    @F.pandas_udf("array<int>")
    def joined(parts: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate([np.frombuffer(x["ids"], f"<u{x['width']}") for x in doc]).astype(np.int32) for doc in parts])

    refs = _recipes(spark, path).select("doc_id", "start", F.posexplode("addresses").alias("pos", "address"))
    docs = refs.join(_chunks(spark, path), "address").groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("pos", "width", "ids"))).alias("parts"))
    return docs.select("doc_id", "start", joined("parts").alias("ids"))


def manifest_holds(spark: SparkSession, path: str, leaves: DataFrame) -> bool:
    """Whether the tree over ``leaves`` (start, root), recomputed, is the manifest's."""
    kept, own = spark.read.schema("level int, node long, root string").parquet(f"{path}/manifest"), _tree(leaves)
    found = own.withColumnRenamed("root", "own").join(kept, ["level", "node"], "full")
    return not found.where("NOT root <=> own").limit(1).count()


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_store(table(spark, sf_dir, "documents"), new_path(spark, "token-store"))
    return read_digests(spark, path)


QUERIES = {"op10_token_store": op10_token_store}
SQL: dict[str, str] = {}
