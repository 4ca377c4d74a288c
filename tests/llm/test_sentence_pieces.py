import hashlib
import os

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtrace.llm import sentence_pieces
from tests.llm.conftest import ROWS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_path())


def same(library, texts):
    coder = sentence_pieces.coder(sentence_pieces.model_path())
    ids, bounds = coder.encode(pa.array(texts, pa.string()))
    numbers, decoded = coder.written_out(ids, bounds), coder.decode(ids, bounds)
    for i, t in enumerate(texts):
        want = library.encode(t or "")
        assert ids[bounds[i] : bounds[i + 1]].tolist() == want
        assert decoded[i].decode() == library.decode(want) and numbers[i] == ",".join(map(str, want)).encode()


LETTERS = st.one_of(st.text(max_size=30), st.text(alphabet="aeinrst  ", max_size=60), st.text(alphabet="=-_ ,.\n\t▁日é😀\x00<>s0x41", max_size=40), st.text(alphabet=" a", max_size=80))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), LETTERS), max_size=6))
def test_as_the_library(library, texts):
    same(library, texts)


def test_runs_of_spaces_and_long_words(library):
    same(library, [" " * n for n in range(70)] + ["x" + " " * n + "the  " for n in range(70)] + [" " * n + "\n" for n in range(40)])
    same(library, ["a" * 1000, "ab" * 777 + "the", "=" * 333, "1234567890" * 9, "日本語のテキスト" * 50, "<s></s><unk><0x41>", "x" * 20 + " " * 3000])


def test_ties_and_better_pairs_after_a_merge():
    """Rounds against one merge at a time, over random pieces with equal scores and pieces better than their parts."""
    import random

    class Toy(sentence_pieces.PieceCoder):
        def __init__(self, pieces):
            chars = "abc"
            symbols = {c: k for k, c in enumerate(chars)} | {s: 3 + k for k, (s, _) in enumerate(pieces)}
            self.merged = sentence_pieces.PairTable({(symbols[s[:k]], symbols[s[k:]]): symbols[s] for s, _ in pieces for k in range(1, len(s)) if s[:k] in symbols and s[k:] in symbols})
            self.rank = sentence_pieces.np.array([99, 99, 99, *(r for _, r in pieces)], sentence_pieces.np.int32)
            self.symbols = symbols

    np = sentence_pieces.np
    r = random.Random(3)
    for _ in range(400):
        names = sorted({"".join(r.choice("abc") for _ in range(r.randrange(2, 5))) for _ in range(r.randrange(1, 14))})
        toy = Toy([(s, r.randrange(6)) for s in names])
        names_of = {v: k for k, v in toy.symbols.items()}
        words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 14))) for _ in range(9)]
        flat = np.array([toy.symbols[c] for w in words for c in w], np.int32)
        out = toy._rounds(flat, np.cumsum([0, *map(len, words)])[:-1])
        at = 0
        for w in words:
            parts = list(w)
            while found := [(toy.rank[toy.symbols[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if len(a + b) > 1 and a + b in toy.symbols]:
                _, i = min(found)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert [names_of[x] for x in out[at : at + len(w)].tolist() if x >= 0] == parts
            at += len(w)


def test_rows_of_odd_tables(spark, odd, none, library):
    got = sentence_pieces.round_trip(odd, sentence_pieces.model_path()).collect()
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in got) == sorted((i or 0, library.encode(t or ""), t or "") for i, t, *_ in ROWS)
    assert sentence_pieces.encoded(odd, sentence_pieces.model_path()).columns == ["doc_id", "ids"]
    assert sentence_pieces.digests(none, sentence_pieces.model_path()).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_op12(spark, library):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    got = {r.doc_id: r for r in sentence_pieces.op12_sentence_pieces(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = library.encode(t or "")
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        assert [got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256] == [len(ids), *digest]
