import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtrace.llm import packing, token_store
from loomtrace.llm.tokens import encoder, tokenizer_path
from tests.llm.conftest import ROWS

SF = "/root/testdata/sf0.001"


def ids_of(text):
    return encoder(tokenizer_path()).library.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBcé'sİΣ.,!?; \n\t0١中~<|>ñ́", max_size=40)), max_size=6))
def test_words_give_the_ids_of_whole_texts(texts):
    ids, bounds = encoder(tokenizer_path()).encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert list(ids[bounds[i] : bounds[i + 1]]) == ids_of(t)[:-1]


def test_store_reads_back_what_was_written(spark, odd, tmp_path):
    path = token_store.write_store(odd, f"file://{tmp_path}/store")
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.read_digests(spark, path).collect())
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, len(ids_of(r[1]))))
    want, start = [], 0
    for i, text, *_ in rows:
        ids = ids_of(text)
        want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    # two equal rows come in either order but get one place each; the grouped digest joins them by start
    assert got == sorted(want)
    back = {r.start: r.ids for r in token_store.read_ids(spark, path).collect()}
    assert all(back[s] == ids_of(next(t for j, t, *_ in rows if j == i)) for s, i, *_ in want)


@pytest.mark.parametrize("ids", [[-(2**62) - 5, 2**62 + 7, 0], [None] * 4 + [3] * 5])
def test_ids_far_apart_and_repeated(spark, tmp_path, ids):
    docs = spark.createDataFrame([(i, "word " * (k + 1)) for k, i in enumerate(ids)], "doc_id long, text string")
    got = [tuple(r) for r in token_store.read_digests(spark, token_store.write_store(docs, f"file://{tmp_path}/s")).orderBy("start").collect()]
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, k))
    assert [r[0] for r in got] == [ids[k] for k in order] and [r[2] for r in got] == [k + 2 for k in order]
    assert [r[1] for r in got] == [sum(k + 2 for k in order[:n]) for n in range(len(ids))]


def test_what_was_changed_is_found(spark, odd, tmp_path):
    path = token_store.write_store(odd.where("doc_id IN (7, 9)"), f"file://{tmp_path}/a")
    names = {n: spark.read.parquet(f"{path}/{n}") for n in ("parts", "recipes", "manifest")}
    spoiled = {
        "parts": names["parts"].withColumn("ids", F.expr("unhex('0100')")),
        "recipes": names["recipes"].withColumn("n_tokens", F.expr("n_tokens + 1")),
        "manifest": names["manifest"].withColumn("root", F.lit("0")),
    }
    for name, rows in spoiled.items():
        for n in names:
            df = rows if n == name else names[n]
            (df.write.partitionBy("kind") if n == "parts" else df.write).parquet(f"{tmp_path}/{name}/{n}")
        with pytest.raises(ValueError, match="manifest" if name == "manifest" else "recipes"):
            token_store.read_digests(spark, f"file://{tmp_path}/{name}")
    assert not any(r.verified for r in token_store.digests(spark, f"file://{tmp_path}/parts").collect())


def test_query(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    want, start = [], 0
    for i, text in rows:
        ids = ids_of(text)
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_store.op10_token_store(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_equal_passages_are_stored_once(spark, tmp_path):
    words = " ".join(f"w{i} x{i * 7 % 31}" for i in range(3000))
    docs = spark.createDataFrame([(i, f"intro {i} " + words) for i in range(20)], "doc_id long, text string")
    path = token_store.write_store(docs, f"file://{tmp_path}/s")
    refs = sum(len(r.addresses) for r in spark.read.parquet(f"{path}/recipes").collect())
    assert token_store._chunks(spark, path).count() < refs / 5
    assert token_store._chunks(spark, path).select("address").distinct().count() == token_store._chunks(spark, path).count()


def test_empty_store(spark, none, tmp_path):
    path = token_store.write_store(none, f"file://{tmp_path}/none")
    assert token_store.read_digests(spark, path).count() == 0


def test_crc_of_joined_strings():
    a, b = b"abc" * 7, b"\x00\x01" * 33
    assert token_store.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert token_store.crc_joined(0, zlib.crc32(b), len(b)) == zlib.crc32(b)


def test_packing_places_every_piece(spark, odd):
    rows = packing.pack(packing.pieces(odd, capacity=64), capacity=64, pieces_each=40).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.length) for r in rows if r.piece == 0) == sorted((i is not None, i or 0, min(64, len(ids_of(t)))) for i, t, *_ in ROWS)
    for i, text, *_ in ROWS:
        ids = ids_of(text)
        for r in rows:
            if r.doc_id == i and i not in (5, None):
                part = ids[r.start : r.start + r.length]
                assert r.start == 64 * r.piece and len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= packing.lower_bound(np.array([r.length for r in rows]), 64) + 1


def test_packing_of_nothing(none):
    assert packing.pack(packing.pieces(none)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=7))
def test_bound_never_exceeds_the_optimum(lengths):
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= 30:
                bins[k] += lengths[i]
                place(i + 1, bins)
                bins[k] -= lengths[i]
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    assert packing.lower_bound(np.array(lengths, np.int64), 30) <= best
    bins, offsets, n = packing.best_fit_decreasing(np.array(lengths, np.int64), 30)
    assert best <= n and (not lengths or n == bins.max() + 1)


def test_forgetting_changes_no_ids(monkeypatch):
    from loomtrace.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    coder = tokens.WordEncoder(tokenizer_path())
    for k in range(12):
        texts = [f"common word{k * 7 + j} other{k}, again{j}." for j in range(7)]
        ids, bounds = coder.encode(pa.array(texts))
        assert [list(ids[a:b]) for a, b in zip(bounds, bounds[1:])] == [ids_of(t)[:-1] for t in texts]
    assert len(coder.words) < 80 and "common" in coder.words.to_pylist()
