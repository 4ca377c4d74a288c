"""Phrases whose words go together, by counts of all phrases of a corpus.

Words are counted first, then phrases of two words, three, and so on. A phrase is
counted only where both phrases of one word less within it may be frequent: for
that, each length leaves a bit set of FILTER_BITS hashes of its frequent phrases.
A hash met by chance costs a count more, never one less, so counts of frequent
phrases are exact, and what goes to workers is 8 MB at any size of the corpus.

Counting is a HAT-trie in each task (``hat_trie``): keys of word ids that the task
hands out to the words of phrases it counts. Beyond TRIE_KEYS keys the largest
subtrees are spilled as sorted runs, one row for each prefix (a phrase without its
last word), and runs are merged by prefix in Spark. A prefix that very many words
follow is dealt over DEALS parts by its last words, so no frequent word makes one
task large; the phrases of a task are added up before the shuffle.

Cases: a null or empty text has no words. A null language is ``und``. Equal rows
count each. Phrases never reach over a mark, a line's end or a text's. A word holds
anything but blanks and marks, control characters too. A very long text is split
at once, memory grows with it. An empty table gives no rows. Other columns are not
read. Counts are 64 bits, products exact decimals of 38 digits: a phrase may occur
10^15 times.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.hat_trie import HatTrie
from loomtrace.llm.shared import Scratch, table, written
from loomtrace.llm.text import buffer_of, slices
from loomtrace.operators.graph import dealt_anew
from loomtrace.operators.ordering import row_numbers

LEAST, LONGEST, TOP = 10, 3, 2000
#: A phrase goes if so many in a hundred of its occurrences are in one longer candidate.
WITHIN = 50
FILTER_BITS = 26
#: Keys of a task's trie before subtrees are spilled; half of them stay.
TRIE_KEYS = 2_000_000
DEALS = 8
#: Languages' first places are sent to all tasks up to so many, a few MB; beyond, they are joined by a shuffle.
BROADCAST_LANGS = 100_000
SLICE_BYTES = 4 << 20

_BLANK, _BREAK = 32, 10


def _table() -> bytes:
    out = bytearray(range(256))
    for c in range(65, 91):
        out[c] = c + 32
    out[9] = _BLANK
    for c in b".,;:!?\n\x0b\x0c\r":
        out[c] = _BREAK
    return bytes(out)


_LETTERS = _table()
_RUNS = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("deal", pa.int32()), ("entries", pa.list_(pa.struct([("last", pa.string()), ("n", pa.int64())])))])


class Phrases:
    """Words of texts: ``codes`` in order, ``pieces`` (equal within a piece), ``vocabulary`` by code."""

    def __init__(self, texts: pa.Array):
        offsets, data = buffer_of(texts)
        x = np.insert(np.frombuffer(data.translate(_LETTERS), np.uint8), offsets[1:-1], _BREAK)
        breaks = x == _BREAK
        apart = np.concatenate([[True], breaks | (x == _BLANK), [True]])
        word = ~apart[1:-1]
        starts, ends = np.flatnonzero(word & apart[:-2]), np.flatnonzero(word & apart[2:]) + 1
        self.pieces = np.cumsum(breaks)[starts] if len(starts) else starts
        edges = np.append(0, np.cumsum(ends - starts))
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges.tobytes()), pa.py_buffer(x[word].tobytes()))
        coded = words.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.vocabulary = coded.dictionary


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def joined(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of their first words and of the last one."""
    h = (first * np.uint64(0x9FB21C651E98DF25)) ^ last
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


def places(hashes: np.ndarray) -> np.ndarray:
    """Where in the bit set."""
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    langs = pc.fill_null(batch.column("lang"), "und")
    for lang in pc.unique(langs).to_pylist():
        yield lang, batch.column("text").filter(pc.equal(langs, lang))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each slice with their counts; the null word counts all."""
    for batch in slices(batches, most=SLICE_BYTES):
        for lang, texts in _by_lang(batch):
            p = Phrases(texts)
            counts = np.append(np.bincount(p.codes, minlength=len(p.vocabulary)), len(p.codes))
            phrases = pa.concat_arrays([p.vocabulary.cast(pa.string()), pa.nulls(1, pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), phrases, pa.array(counts, pa.int64())], ["lang", "phrase", "n"])


class TaskCounts:
    """One language's trie in a task, and the ids of the words in it."""

    def __init__(self, lang: str, size: int, keys: int):
        self.lang, self.size, self.most = lang, size, keys
        self.width = 63 // size
        # ids are dealt over the keys' digits, so the first ones aren't all under one node
        self.mix = np.uint64(0x9E3779B1 % (1 << self.width) | 1)
        self.back = np.uint64(pow(int(self.mix), -1, 1 << self.width))
        self.mask = np.uint64((1 << self.width) - 1)
        self._start()

    def _start(self) -> None:
        self.ids: dict[str, int] = {}
        self.trie = HatTrie(self.width * self.size)

    def add(self, p: Phrases, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Count the phrases that begin at ``at``; yields runs where room is needed."""
        step = max(1, (1 << self.width) // (2 * self.size))  # places whose words have ids together
        for begin in range(0, len(at), step):
            part = at[begin : begin + step]
            codes = [p.codes[part + k] for k in range(self.size)]
            used = np.zeros(len(p.vocabulary), bool)
            for c in codes:
                used[c] = True
            words = p.vocabulary.filter(pa.array(used)).to_pylist()
            if len(self.ids) + len(words) > 1 << self.width:
                yield from self.spilled(0)
                self._start()
            ids = np.zeros(len(used), np.uint64)
            ids[used] = np.fromiter((self.ids.setdefault(w, len(self.ids)) for w in words), np.uint64, len(words))
            ids = (ids * self.mix) & self.mask
            keys = reduce(lambda a, c: a << np.uint64(self.width) | ids[c], codes, np.uint64(0))
            keys.sort()
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            self.trie.add(keys[first], np.diff(np.append(first, len(keys))))
        if self.trie.n > self.most:
            yield from self.spilled(self.most // 2)

    def spilled(self, leave: int) -> Iterator[pa.RecordBatch]:
        """Subtrees as sorted runs, one row for each prefix and part of its last words."""
        words = pa.array(list(self.ids), pa.string())
        deals = np.fromiter((xxhash.xxh32_intdigest(w) % DEALS for w in self.ids), np.uint64, len(self.ids))
        for keys, counts in self.trie.spill(leave):
            last = self._word(keys, 0)
            group = (keys >> np.uint64(self.width)) * np.uint64(DEALS) + deals[last]
            order = np.argsort(group, kind="stable")
            group, keys, last, counts = group[order], keys[order], last[order], counts[order]
            edges = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(keys))
            heads = keys[edges[:-1]]
            prefix = [words.take(pa.array(self._word(heads, k))) for k in range(self.size - 1, 0, -1)]
            prefix = pc.binary_join_element_wise(*prefix, " ") if len(prefix) > 1 else prefix[0]
            entries = pa.StructArray.from_arrays([words.take(pa.array(last)), pa.array(counts, pa.int64())], fields=list(_RUNS.field("entries").type.value_type))
            entries = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), entries)
            deal = pa.array((group[edges[:-1]] % np.uint64(DEALS)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(heads), pa.string()), prefix, deal, entries], schema=_RUNS)

    def _word(self, keys: np.ndarray, k: int) -> np.ndarray:
        """The id of the word that stands ``k`` before the last."""
        return ((((keys >> np.uint64(self.width * k)) & self.mask) * self.back) & self.mask).astype(np.int64)


def _runs(size: int, found, trie_keys: int):
    """Runs of phrases of ``size`` words; ``found``: the bit set of frequent ones of a word less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, tasks = np.frombuffer(found.value, np.uint8), {}
        for batch in slices(batches, most=SLICE_BYTES):
            for lang, texts in _by_lang(batch):
                p = Phrases(texts)
                if len(p.codes) < size:
                    continue
                h = word_hashes(lang, p.vocabulary.to_pylist())[p.codes]
                shorter = reduce(lambda a, k: joined(a[:-1], h[k:]), range(1, size - 1), h)
                at = places(shorter)
                may = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                n = len(h) - size + 1
                begin = np.flatnonzero(may[:n] & may[1 : n + 1] & (p.pieces[:n] == p.pieces[size - 1 :]))
                if lang not in tasks:
                    tasks[lang] = TaskCounts(lang, size, trie_keys)
                yield from tasks[lang].add(p, begin)
            # languages share the room
            while sum(t.trie.n for t in tasks.values()) > trie_keys:
                yield from max(tasks.values(), key=lambda t: t.trie.n).spilled(trie_keys // (2 * len(tasks)))
        for t in tasks.values():
            yield from t.spilled(0)

    return run


def _places(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang")
            for lang in pc.unique(langs).to_pylist():
                phrases = batch.column("phrase").filter(pc.equal(langs, lang))
                words = pc.split_pattern(phrases, " ").flatten().to_pylist()
                h = word_hashes(lang, words).reshape(-1, size)
                h = reduce(lambda a, k: joined(a, h[:, k]), range(1, size), h[:, 0])
                yield pa.RecordBatch.from_arrays([pa.array(places(h))], ["place"])

    return run


def bit_set(phrases: DataFrame, size: int) -> bytes:
    """2^FILTER_BITS bits (8 MB), set where phrases of ``size`` words hash to."""
    block = 1 << 15
    at = phrases.select("lang", "phrase").mapInArrow(_places(size), "place long")
    blocks = at.groupBy(F.expr(f"place div {block}").alias("block")).agg(F.bitmap_construct_agg(F.pmod("place", F.lit(block))).alias("bits"))
    out = bytearray(1 << FILTER_BITS - 3)
    for row in blocks.toLocalIterator():
        begin = row.block * block // 8
        out[begin : begin + block // 8] = row.bits
    return bytes(out)


def counted(docs: DataFrame, aside: Scratch, longest: int = LONGEST, least: int = LEAST, trie_keys: int = TRIE_KEYS) -> tuple[DataFrame, DataFrame]:
    """Exact counts: lang, phrase, size, n of phrases with n >= ``least``; and lang, n of all words."""
    texts = docs.select("lang", "text")
    words = texts.mapInArrow(_words, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    words = aside.written(words.where((F.col("n") >= least) | F.col("phrase").isNull()), "words")
    totals = words.where("phrase IS NULL").select("lang", "n")
    level = words.where("phrase IS NOT NULL")
    found = level.withColumn("size", F.lit(1))
    for size in range(2, longest + 1):
        bits = docs.sparkSession.sparkContext.broadcast(bit_set(level, size - 1))
        runs = texts.mapInArrow(_runs(size, bits, trie_keys), "lang string, prefix string, deal int, entries array<struct<last: string, n: long>>")
        merged = runs.repartition("lang", "prefix", "deal").select("lang", "prefix", "deal", F.inline("entries"))
        merged = merged.groupBy("lang", "prefix", "deal", "last").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        level = aside.written(merged.select("lang", F.concat_ws(" ", "prefix", "last").alias("phrase"), "n"), "phrases")
        bits.destroy()
        found = found.unionByName(level.withColumn("size", F.lit(size)))
    return found, totals


def _part(begin, length):
    """Words of a phrase from the one numbered ``begin`` on, joined."""
    return F.array_join(F.slice("words", begin, length), " ")


#: Quotients are at most 10^6, as no part is rarer than the whole.
_SCORE = "(cast(1000000 AS decimal(7,0)) * cast(a AS decimal(16,0)) * cast(a AS decimal(16,0))) div (cast(l AS decimal(16,0)) * cast(r AS decimal(16,0)))"


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, score of phrases of two words or more, by the cut of the lowest score."""
    longer = found.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = longer.select("lang", "phrase", "size", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    known = found.select("lang", "phrase", "n")
    cuts = cuts.join(dealt_anew(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), "lang", "first"), ["lang", "first"])
    cuts = cuts.join(dealt_anew(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), "lang", "rest"), ["lang", "rest"])
    lowest = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(F.expr(_SCORE).alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def without_contained(candidates: DataFrame, within: int = WITHIN) -> DataFrame:
    """Candidates of which no longer one has ``within`` in a hundred of the occurrences or more."""
    longer = candidates.where("size > 2").select("lang", "a", "size", F.split("phrase", " ").alias("words"))
    spans = longer.select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("span"))
    spans = spans.select("lang", "a", "words", "span", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("span") + 1)).alias("begin"))
    most = spans.groupBy("lang", _part(F.col("begin"), F.col("span")).alias("phrase")).agg(F.max("a").alias("longer"))
    rows = candidates.join(dealt_anew(most, "lang", "phrase"), ["lang", "phrase"], "left")
    return rows.where(F.col("longer").isNull() | (100 * F.col("longer") < within * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, trie_keys: int = TRIE_KEYS) -> DataFrame:
    """Each language's ``top`` phrases by score: lang, rank, phrase, a, l, r, n, score."""
    with Scratch(docs.sparkSession) as aside:
        found, totals = counted(docs, aside, longest, least, trie_keys)
        candidates = aside.written(scored(found), "candidates")
        rows = without_contained(candidates)
        # places in the order of all languages, ranged over tasks, less those of the languages before
        rows = aside.written(row_numbers(rows, [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")], "place"), "placed")
        first = aside.written(rows.groupBy("lang").agg(F.min("place").alias("first")), "languages")
        few = first.count() <= BROADCAST_LANGS
        rows = rows.join(F.broadcast(first) if few else dealt_anew(first, "lang"), "lang").withColumn("rank", F.col("place") - F.col("first") + 1).where(F.col("rank") <= top)
        return written(rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, piece_id, unnest(w) AS x, generate_subscripts(w, 1) AS i
    FROM (SELECT lang, row_number() OVER () AS piece_id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces)
), follow AS (
    SELECT lang, x, lead(x) OVER place AS y, lead(x, 2) OVER place AS z FROM words WINDOW place AS (PARTITION BY piece_id ORDER BY i)
), ones AS (
    SELECT lang, x AS phrase, count(*) AS c FROM follow GROUP BY ALL
), twos AS (
    SELECT lang, x || ' ' || y AS phrase, count(*) AS c FROM follow WHERE y IS NOT NULL GROUP BY ALL
), threes AS (
    SELECT lang, x || ' ' || y || ' ' || z AS phrase, count(*) AS c FROM follow WHERE z IS NOT NULL GROUP BY ALL
), totals AS (
    SELECT lang, sum(c)::BIGINT AS n FROM ones GROUP BY lang
), split AS (
    SELECT lang, phrase, c AS a, string_split(phrase, ' ') AS s FROM twos WHERE c >= 10
    UNION ALL SELECT lang, phrase, c, string_split(phrase, ' ') FROM threes WHERE c >= 10
), cuts AS (
    SELECT p.lang, p.phrase, len(s) AS size, a, 1 AS k, l.c AS l, coalesce(r1.c, r2.c) AS r
    FROM split p JOIN ones l ON l.lang = p.lang AND l.phrase = s[1]
    LEFT JOIN ones r1 ON len(s) = 2 AND r1.lang = p.lang AND r1.phrase = s[2]
    LEFT JOIN twos r2 ON len(s) = 3 AND r2.lang = p.lang AND r2.phrase = s[2] || ' ' || s[3]
    UNION ALL
    SELECT p.lang, p.phrase, 3, a, 2, l.c, r.c
    FROM split p JOIN twos l ON l.lang = p.lang AND l.phrase = s[1] || ' ' || s[2] JOIN ones r ON r.lang = p.lang AND r.phrase = s[3]
    WHERE len(s) = 3
), scores AS (
    SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts
), best AS (
    SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, s[1] || ' ' || s[2] AS phrase, a FROM split WHERE len(s) = 3
        UNION ALL SELECT lang, s[2] || ' ' || s[3], a FROM split WHERE len(s) = 3
    ) GROUP BY ALL
), ranked AS (
    SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
    FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

QUERIES = {"op11_collocations": op11_collocations}
SQL = {"op11_collocations": _SQL}
