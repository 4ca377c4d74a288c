"""The registered queries, over the smallest tables, against brute force."""

import hashlib
import math
import os
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loomtrace.llm import chat, decontaminate, language, packing, quality, simhash, toxicity
from tests.llm.test_dedup import fingerprint
from tests.llm.test_filters import base, leaks
from tests.llm.test_tokens import ids_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def read(name, columns="*"):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_op1(spark):
    langs = dict(read("documents", "doc_id, lang"))
    got = {r.doc_id: r for r in language.op1_gru_language(spark, SF).collect()}
    assert got.keys() == langs.keys() and all(r.held_out == held_out(i) and 0 <= r.score <= 1 for i, r in got.items())
    out = [i for i in got if held_out(i) and langs[i]]
    assert sum(got[i].lang_pred == langs[i] for i in out) >= 0.9 * len(out)


def test_op1_pooling_against_plain_positions():
    """Every byte's label by one unit at a time, then the mean over a document."""
    rng = np.random.default_rng(2)
    p = {k: v.astype(np.float64) for k, v in language.initial(3, rng).items()}
    model = {"langs": ["x", "y", "z"], "p": p}
    texts = ["Ab, cd 12!", "É" * 50 + " the end", "", "?! 77", None, "q" * 65, "ΑΒΓ"]
    soft = lambda v: v / (1 + abs(v))

    def states(data, d):
        h, out = [0.0] * language.HIDDEN, []
        for byte in data:
            x, s = p[d + "x"][byte], [sum(h[i] * p[d + "u"][i][k] for i in range(language.HIDDEN)) for k in range(3 * language.HIDDEN)]
            new = []
            for j in range(language.HIDDEN):
                z = (1 + soft(x[j] + s[j])) / 2
                r = (1 + soft(x[language.HIDDEN + j] + s[language.HIDDEN + j])) / 2
                c = soft(x[2 * language.HIDDEN + j] + r * s[2 * language.HIDDEN + j])
                new.append(c + z * (h[j] - c))
            h = new
            out.append(h)
        return out

    langs, scores = language.labelled(model, pa.array(texts, pa.string()))
    for text, lang, score in zip(texts, langs, scores):
        if not any(map(str.isalpha, text or "")):
            assert (lang, score) == ("und", 0)
            continue
        data = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
        total = np.zeros(3)
        for at in range(0, len(data), language.SEGMENT):
            part = data[at : at + language.SEGMENT]
            for f, b in zip(states(part, "f"), states(part[::-1], "b")[::-1]):
                y = np.array(f + b) @ p["o"] + p["c"]
                total += y - np.log(np.exp(y).sum())
        q = np.exp(total / len(data))
        q /= q.sum()
        assert lang == "xyz"[int(q.argmax())] and abs(score - q.max()) < 1e-9


def test_op2(spark):
    texts = dict(read("documents", "doc_id, text"))
    for r in quality.op2_line_quality(spark, SF).collect():
        counts = base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and not (r.base_failed and r.kept)


def test_op3(spark):
    turns = read("conversations", "conv_id, turn")
    got = chat.op3_hmm_chat(spark, SF).collect()
    assert {r.conv_id for r in got} == {c for c, _ in turns} and sum(r.n_turns for r in got) == len(turns)


def test_op5(spark):
    marked = dict(read("labels", "doc_id, toxic"))
    got = {r.doc_id: r for r in toxicity.op5_ftrl_toxicity(spark, SF).collect()}
    assert len(got) == len(read("documents", "doc_id"))
    assert all(r.held_out == held_out(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    clean = [i for i, y in marked.items() if y == 0]
    assert sum(got[i].predicted for i in clean) <= 0.02 * len(clean)


def test_op6(spark):
    texts = dict(read("documents", "doc_id, text"))
    got = packing.op6_best_fit_packing(spark, SF).collect()
    pieces, bins = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in texts.items():
        ids, at = np.array(ids_of(text), "<u4"), 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == min(4096, len(ids) - at)
            at += r.length
        assert at == len(ids)
    for parts in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)])]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096
    assert len(bins) <= packing.lower_bound(np.array([r.length for r in got]), 4096) + 1


def test_op7(spark):
    texts = dict(read("documents", "doc_id, text"))
    prints = {i: fingerprint(t) for i, t in texts.items()}
    got = {r.doc_id: r for r in simhash.op7_simhash_components(spark, SF).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    root = {}
    for i in sorted(prints):
        if i in root:
            continue
        todo = [i]
        root[i] = i
        while todo:
            a = prints[todo.pop()]
            new = [j for j, b in prints.items() if j not in root and bin(a ^ b).count("1") <= 2]
            root.update(dict.fromkeys(new, i))
            todo += new
    assert {i: r.component_id for i, r in got.items()} == root


def test_op9(spark):
    texts, items = dict(read("documents", "doc_id, text")), read("benchmark", "item_id, text")
    got = {r.doc_id: r for r in decontaminate.op9_fm_decontamination(spark, SF).collect()}
    for i, t in texts.items():
        n, hit, found = leaks(t, items, 10)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), digest, hit > 0)
    assert any(r.contaminated for r in got.values()) and math.isfinite(len(got))
