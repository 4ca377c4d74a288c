import os
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtrace.llm import collocations, hat_trie
from loomtrace.llm.shared import Scratch

SF = "/root/testdata/sf0.001"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 500), max_size=80), max_size=8), st.integers(0, 200))
def test_trie_counts_exactly_and_spills_whole_subtrees(blocks, leave):
    trie, want, got = hat_trie.HatTrie(12, burst=8), Counter(), Counter()
    for block in blocks:
        want.update(block)
        keys, n = np.unique(np.array(block, np.uint64) * np.uint64(8), return_counts=True)
        trie.add(keys, n)
        if trie.n > leave:
            for run, counts in trie.spill(leave):
                assert (np.diff(run.astype(np.int64)) > 0).all()
                got.update(dict(zip((run // 8).tolist(), counts.tolist())))
            assert trie.n <= leave
    for run, counts in trie.spill(0):
        got.update(dict(zip((run // 8).tolist(), counts.tolist())))
    assert got == want and trie.n == 0


def test_hot_prefix_bursts_into_deeper_nodes():
    trie = hat_trie.HatTrie(30, burst=64)
    hot = np.arange(5_000, dtype=np.uint64) + np.uint64(7 << 24)
    trie.add(hot, np.ones(5_000, np.int64))
    trie.add(hot, np.ones(5_000, np.int64))
    depth, node = 0, trie.root
    while isinstance(node, hat_trie.Node):
        depth, node = depth + 1, next(c for c in node.children if c is not None)
    assert depth > 2 and node.n <= 64
    assert [(k.tolist(), c.tolist()) for k, c in trie.spill(0)] == [(hot.tolist(), [2] * 5_000)]


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def plain(rows, longest, least, top, within=50):
    """lang -> ranked rows, by the definition."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in words_of(text):
            n[lang or "und"] += len(piece)
            for k in range(1, longest + 1):
                f.update((lang or "und", *piece[i : i + k]) for i in range(len(piece) - k + 1))
    found = {}
    for (lang, *p), a in f.items():
        if len(p) > 1 and a >= least:
            cuts = [(1_000_000 * a * a // (f[(lang, *p[:k])] * f[(lang, *p[k:])]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, tuple(p)] = (a, f[(lang, *p[:k])], f[(lang, *p[k:])], score)
    out = set()
    for lang in n:
        ranked = []
        for (of, p), (a, l, r, score) in found.items():
            longer = [b for (o, q), (b, *_) in found.items() if o == of == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if of == lang and all(100 * b < within * a for b in longer):
                ranked.append((-score, -a, " ".join(p).encode(), l, r))
        out |= {(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(ranked)[:top])}
    return out


LINES = ["New York city hall", "in new york. the THE the the", "a b\tc  a b c", "x\ny z, x y z; é ü É ü", "of the new york times", ""]
ROWS = [(i, LINES[i % 6] + " " + LINES[i * i % 5], ["en", None, "de"][i % 7 % 3]) for i in range(150)] + [(None, None, "en"), (None, " ,\n", None)]


@pytest.mark.parametrize("longest,least,top,keys", [(3, 10, 2000, 2_000_000), (3, 2, 9, 20), (4, 3, 500, 7), (2, 1, 5, 1)])
def test_against_plain_counts(spark, longest, least, top, keys):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").selectExpr("*", "1 AS n", "'x' AS phrase", "2 AS prefix").repartition(3)
    got = {tuple(r) for r in collocations.collocations(docs, longest, least, top, keys).collect()}
    assert got == plain([(r[2], r[1]) for r in ROWS], longest, least, top) and got


def test_ids_run_out(spark):
    """Five words a key leave 4,096 ids: more words than that take several tries."""
    words = [f"w{i}" for i in range(6_000)]
    docs = spark.createDataFrame([(i, " ".join(words), "en") for i in range(2)], "doc_id long, text string, lang string").coalesce(1)
    with Scratch(spark) as aside:
        found, totals = collocations.counted(docs, aside, 5, 2)
        assert found.groupBy("size", "n").count().orderBy("size").collect() == [(k, 2, 6_001 - k) for k in range(1, 6)]
        assert totals.collect() == [("en", 12_000)]


def test_large_counts_are_exact(spark):
    big = 10**15 - 3
    found = spark.createDataFrame([("en", "a", 1, big + 2), ("en", "b", 1, big + 1), ("en", "a b", 2, big)], "lang string, phrase string, size int, n long")
    (row,) = collocations.scored(found).collect()
    assert row.score == 1_000_000 * big * big // ((big + 2) * (big + 1))


def test_odd_and_empty_tables(spark, odd, none):
    got = collocations.collocations(odd, least=2).collect()
    assert {r.phrase for r in got} >= {"with some words"} and all(r.lang in ("en", "de", "fr", "und") for r in got)
    assert collocations.collocations(none).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_op11(spark):
    got = {tuple(r) for r in collocations.op11_collocations(spark, SF).collect()}
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == set(c.sql(collocations.SQL["op11_collocations"]).fetchall()) and got


def test_pieces_of_texts():
    p = collocations.Phrases(pa.array(["A b.c", None, "d\x0be f", "", "g"]))
    words = [p.vocabulary[c].as_py() for c in p.codes]
    assert words == ["a", "b", "c", "d", "e", "f", "g"] and np.diff(p.pieces).astype(bool).tolist() == [False, True, True, True, False, True]
