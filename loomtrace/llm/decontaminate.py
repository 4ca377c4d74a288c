"""Benchmark decontamination: an FM-index of each shard of training text.

A shard is a slice of documents inside a task; nothing is shuffled. All its words
are indexed, numbered by the shard's own vocabulary, each document with an end of
its own. Test phrases are found by backward search through a wavelet matrix of the
Burrows-Wheeler transform, occurrences located by sampled suffix positions, and the
spans they cover merged. A phrase with a word that the shard lacks isn't in it.

Phrases are windows of ``width`` consecutive words of an item; an item of fewer
words, but not none, is one phrase. They go to the tasks in blocks of bounded
size, ``STAGE_BLOCKS`` to a pass over the texts; a larger benchmark takes more
passes, each adding to the spans. Repeated items count once, and long ones are cut
into parts that share the words of all but one window, so no block is large.

Cases: null and empty texts have no words and are clean. Windows of items with null
item_id are hit like any other, but there is no id to list or count; items that
share an item_id are one item. A very long text is a shard of its own, indexed
whole. Empty tables: no rows, or no hits. Repeated rows stay. Other columns pass
through; ones named like an output column are not kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.shared import added, bucketed, table, without, written
from loomtrace.llm.text import ALNUM, Words, slices, spread

WIDTH = 10
#: Characters of test items in one block of phrases, and blocks that a pass over the texts searches.
BLOCK_CHARS, STAGE_BLOCKS = 4_000_000, 4
#: Windows of one part of an item.
PART_WORDS = 50_000
#: Text of one shard; a longer text is a shard of its own.
SHARD_BYTES = 4 << 20
#: Every so manieth suffix position is kept.
SAMPLE = 8
_FOUND = "n_words long, n_hit long, spans array<struct<begin: long, end: long>>, items array<long>"
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit of a symbol a level: 64 bits a word, and how many are set before each word."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.words, self.ones, self.zeros = bits, [], [], []
        level = symbols
        for b in reversed(range(bits)):
            up = (level >> b) & 1 == 1
            words = np.zeros(len(level) // 64 + 1, "<u8")
            words.view(np.uint8)[: -(-len(level) // 8)] = np.packbits(up, bitorder="little")
            ones = np.zeros(len(words) + 1, np.int32)
            np.cumsum(np.bitwise_count(words), dtype=np.int32, out=ones[1:])
            self.words.append(words)
            self.ones.append(ones)
            self.zeros.append(len(level) - int(ones[-1]))
            level = np.concatenate([level[~up], level[up]])

    def _set_before(self, k: int, at: np.ndarray) -> np.ndarray:
        """Bits of a level that are set before ``at``."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[k][word] + np.bitwise_count(self.words[k][word] & below)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each symbol, how many come before ``at``."""
        begin = np.zeros_like(at)
        for k, zeros in enumerate(self.zeros):
            up = (symbol >> (self.bits - 1 - k)) & 1 == 1
            a, b = self._set_before(k, at), self._set_before(k, begin)
            at, begin = np.where(up, zeros + a, at - a), np.where(up, zeros + b, begin - b)
        return at - begin


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes in ascending order; each 0 is a symbol of its own, in order of place, below all others.

    Suffixes sorted by their first k symbols are sorted by 2k of them through the
    ranks k further on; those that are told apart are left alone.
    """
    n = len(text)
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text + ends.sum())
    # a text has less than 2 GB, so places fit 32 bits; pairs of ranks don't
    order = np.argsort(rank, kind="stable").astype(np.int32)
    keys, slots, step = rank[order], np.arange(n, dtype=np.int32), 1
    rank = np.empty(n, np.int32)
    at = order
    while True:
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at), dtype=np.int32), 0))]
        slots = slots[~(new & np.append(new[1:], True))]
        if not len(slots):
            return order
        at = order[slots]
        keys = at.astype(np.int64) + step
        keys = np.where(keys < n, rank[np.minimum(keys, n - 1)] + 1, 0) + rank[at] * np.int64(n + 1)
        by = np.argsort(keys)
        at, keys = at[by], keys[by]
        order[slots] = at
        step *= 2


class FMIndex:
    """Over a sequence of symbols from 1 up in which each 0 ends a run; the last is 0."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        order = suffix_order(text)
        self.before = np.where(order > 0, text[order - 1], 0)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))])
        self.matrix = WaveletMatrix(self.before, max(1, int(n_symbols).bit_length()))
        sampled = (order % SAMPLE == 0) | (self.before == 0)
        self.sampled, self.kept = sampled, order[sampled]
        self.kept_at = np.cumsum(sampled, dtype=np.int32) - 1

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase (one a row of symbols)."""
        n = len(self.before)
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), n, np.int64)
        live = np.arange(len(phrases))
        for k in reversed(range(phrases.shape[1])):
            c = phrases[live, k]
            low[live] = self.first[c] + self.matrix.rank(c, low[live])
            high[live] = self.first[c] + self.matrix.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows: step back to a sampled one."""
        out, at, steps, todo = np.zeros(len(rows), np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(todo):
            there = self.sampled[at]
            out[todo[there]] = self.kept[self.kept_at[at[there]]] + steps
            todo, at = todo[~there], at[~there]
            c = self.before[at]
            at = self.first[c] + self.matrix.rank(c, at)
            steps += 1
        return out


class Phrases:
    """Distinct phrases of a block of items, by length: their words' codes, and the items that have each (ids from begin to end)."""

    def __init__(self, items: list[tuple[int | None, str]], width: int):
        code: dict[str, int] = {}
        rows: dict[int, tuple[list, list, list]] = {}
        for item, text in items:
            words = np.array([code.setdefault(w, len(code)) for w in words_of(text)], np.int32)
            if len(words):
                phrases, owners, named = rows.setdefault(min(width, len(words)), ([], [], []))
                phrases.append(np.lib.stride_tricks.sliding_window_view(words, min(width, len(words))))
                owners.append(np.full(len(phrases[-1]), item or 0, np.int64))
                named.append(np.full(len(phrases[-1]), item is not None))
        self.vocabulary, self.lengths = pa.array(list(code), pa.string()), {}
        for n, (phrases, owners, named) in rows.items():
            distinct, of = np.unique(np.concatenate(phrases), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([of.ravel(), np.concatenate(owners)], 1)[np.concatenate(named)], axis=0)
            self.lengths[n] = distinct, np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1]


_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_UPPER))


class Shard:
    """The index of a slice of documents, and where its symbols are."""

    def __init__(self, words: Words):
        self.vocabulary = words.vocabulary
        n = len(words.counts)
        # every document's words, then its end
        ends = words.bounds[1:] + np.arange(n)
        text = np.zeros(len(words.codes) + n, np.int32)
        self.doc = np.repeat(np.arange(n, dtype=np.int32), words.counts + 1)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = words.codes + 1
        self.index = FMIndex(text, len(words.vocabulary))

    def occurrences(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Begin (a word's place in the slice) and length of every occurrence, and (document, item) of those in pairs."""
        symbol = pc.fill_null(pc.index_in(phrases.vocabulary, self.vocabulary), -1).to_numpy().astype(np.int64) + 1
        at, size, docs, items = ([np.zeros(0, np.int64)] for _ in range(4))
        for n, (rows, edges, owners) in phrases.lengths.items():
            rows = symbol[rows]
            here = np.flatnonzero((rows > 0).all(1))
            low, high = self.index.search(rows[here])
            place = self.index.locate(spread(low, high - low))
            phrase = np.repeat(here, high - low)
            doc = self.doc[place]
            at.append(place - doc)  # less the ends before
            size.append(np.full(len(place), n))
            pairs = np.unique(np.stack([doc, phrase], 1), axis=0) if len(place) else np.zeros((0, 2), np.int64)
            counts = edges[pairs[:, 1] + 1] - edges[pairs[:, 1]]
            docs.append(np.repeat(pairs[:, 0], counts))
            items.append(owners[spread(edges[pairs[:, 1]], counts)])
        return np.concatenate(at), np.concatenate(size), np.concatenate(docs), np.concatenate(items)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the words of each span and what lies between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def _searched(batch: pa.RecordBatch, blocks: list[Broadcast], names: list[str], clean: bool) -> pa.RecordBatch:
    """One shard's rows; its index goes on return, before the next one is made."""
    words = Words(batch.column("text"), ALNUM)
    shard = Shard(words)
    edge = np.zeros(len(words.codes) + 1, np.int64)
    items: dict[int, set[int]] = {}
    for block in blocks:
        at, size, docs, owners = shard.occurrences(block.value)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
        for d, item in zip(docs.tolist(), owners.tolist()):
            items.setdefault(d, set()).add(item)
    begins = words.bounds.tolist()
    if "spans" in batch.schema.names:
        for d, (spans, before) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())):
            for x in spans:
                edge[begins[d] + x["begin"]] += 1
                edge[begins[d] + x["end"]] -= 1
            if before:
                items.setdefault(d, set()).update(before)
    hit = np.cumsum(edge[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[words.bounds[1:]] - total[words.bounds[:-1]]
    spans = [[] for _ in range(batch.num_rows)]
    for d in np.flatnonzero(n_hit).tolist():
        x = np.concatenate([[0], hit[begins[d] : begins[d + 1]].astype(np.int8), [0]])
        turns = np.flatnonzero(np.diff(x)).tolist()
        spans[d] = list(zip(turns[::2], turns[1::2]))
    columns = {n: batch.column(n) for n in names}
    if clean:
        texts = batch.column("text").to_pylist()
        columns["clean_text"] = pa.array([_without(t, s) if s else t for t, s in zip(texts, spans)], pa.string())
    columns |= {
        "n_words": pa.array(words.counts), "n_hit": pa.array(n_hit),
        "spans": pa.array([[{"begin": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
        "items": pa.array([sorted(items.get(d, ())) for d in range(batch.num_rows)], pa.list_(pa.int64())),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _search(blocks: list[Broadcast], names: list[str], clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SHARD_BYTES):
            yield _searched(batch, blocks, names, clean)

    return run


def _parts(width: int, windows: int):
    """Items cut into parts of at most so many windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SHARD_BYTES):
            ids, texts = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                for at in range(0, max(1, len(words) - width + 1), windows):
                    ids.append(item)
                    texts.append(" ".join(words[at : at + windows + width - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["item_id", "text"])

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_chars: int = BLOCK_CHARS, clean: bool = False) -> DataFrame:
    """The columns of ``docs``, n_words, n_hit, spans (word places, end exclusive), items (ids with occurring phrases) and, on request, clean_text."""
    out = without(docs, {"n_words", "n_hit", "spans", "items", "clean_text"})
    names, plain = out.columns, out
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    # repeats are one, and no part is large beside a block
    items = written(items.mapInArrow(_parts(width, PART_WORDS), "item_id long, text string").where("text != ''").distinct(), "items")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = bucketed(chars, block_chars)
    for first in range(0, blocks, STAGE_BLOCKS):
        shared = []
        for k in range(first, min(blocks, first + STAGE_BLOCKS)):
            block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
            phrases = Phrases([tuple(r) for r in block.collect()], width)  # bounded by block_chars
            shared.append(docs.sparkSession.sparkContext.broadcast(phrases))
        last = clean and first + STAGE_BLOCKS >= blocks
        out = out.mapInArrow(_search(shared, names, last), added(plain, ("clean_text string, " if last else "") + _FOUND))
    return out


def op9_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op9_fm_decontamination": op9_fm_decontamination}
SQL: dict[str, str] = {}
