"""SentencePiece byte-pair encoding and decoding of whole texts by vectorised merge rounds.

The library turns each space into a mark, puts one mark before a text, and then
merges, again and again, the leftmost pair of neighbouring symbols whose piece has
the best score. No piece of a supported model goes on from a letter to a mark, so
every mark begins a word of its own, and the distinct words of a slice are encoded
once. Their symbols lie in one flat array, cut further at every two characters
that no piece has side by side. A round takes the minimum pair rank of each
segment, merges the leftmost pairs of that rank all at once, and leaves only
segments in which a pair is left; rounds end when there is none.

Merging several pairs of a rank at once is what the library does one by one, as
long as none of them makes a new pair of the same or a better rank: a segment's
merges of a round end with the first that does, so any scores and ties come out
right.

Spaces in a row are marks whose pieces tie for the worst score. They are merged
last and from the left, whatever follows: if as many marks as the longest piece
has become that piece, a run begins with it again and again, and only what is left
of it, shorter than that, has ids of its own, found once for a model.

Characters that the model lacks become the pieces of their UTF-8 bytes. Decoding
joins the bytes of pieces, turns marks into spaces and drops the first one.

Cases: a null or empty text has no ids and decodes to an empty one. A null doc_id
stays. Repeated rows give equal rows. A mark (U+2581) in a text reads as a space,
as in the library. A text of any length is encoded whole; memory grows with it, and
a word of many letters without a cut takes as many rounds as it has ranks. An empty
table gives no rows. Other columns are not read. A model that normalises, samples,
has pieces of the user's own or pieces beyond a mark within raises.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from loomtrace.llm.shared import table
from loomtrace.llm.text import buffer_of, slices, spread

MARK = "▁"
#: Text encoded at once; a longer text is encoded whole.
SLICE_BYTES = 4 << 20
_NONE = np.int32(2**31 - 1)
_READY: dict = {}


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def coder(path: str) -> "PieceCoder":
    """This worker's coder for a model file."""
    if path not in _READY:
        _READY[path] = PieceCoder(path)
    return _READY[path]


class PairTable:
    """Numbers by pairs of symbols: open addressing in flat arrays, looked up for whole arrays at once."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int32)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            placed = self.keys[at] == keys
            self.values[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], (at[~placed] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of each pair, or -1."""
        keys = left.astype(np.int64) << 32 | right
        at = self._slots(keys)
        met = self.keys[at]
        out = np.where(met == keys, self.values[at], np.int32(-1))
        todo = np.flatnonzero((met != keys) & (met != -1))
        while len(todo):
            at_ = at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            met = self.keys[at_]
            same = met == keys[todo]
            out[todo[same]] = self.values[at_[same]]
            todo = todo[~same & (met != -1)]
        return out


class PieceCoder:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as format_

        model = format_.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        pieces = [(p.piece, p.score, p.type) for p in model.pieces]
        kinds = format_.ModelProto.SentencePiece
        normal = {s: (i, score) for i, (s, score, kind) in enumerate(pieces) if kind == kinds.NORMAL}
        self._check(model, normal, {kind for _, _, kind in pieces} - {kinds.NORMAL, kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN})
        self.byte_ids = np.array([next(i for i, (s, _, kind) in enumerate(pieces) if kind == kinds.BYTE and s == f"<0x{b:02X}>") for b in range(256)], np.int32)

        # symbols: the pieces by id, then characters that are only part of pieces, then all other characters
        chars = sorted({c for s in normal for c in s})
        inner = [c for c in chars if c not in normal]
        symbols = {s: i for s, (i, _) in normal.items()} | {c: len(pieces) + k for k, c in enumerate(inner)}
        self.size = len(pieces)
        self.first_unknown = len(pieces) + len(inner)
        self.inner = np.array([ord(c) for c in inner], np.int32)
        self.of_char = np.arange(0x110000, dtype=np.int32) + self.first_unknown
        for c in chars:
            self.of_char[ord(c)] = symbols[c]
        self.mark = symbols[MARK]

        ranks = {score: k for k, score in enumerate(sorted({score for _, score in normal.values()}, reverse=True))}
        self.rank = np.full(self.size, _NONE, np.int32)
        for i, score in normal.values():
            self.rank[i] = ranks[score]
        pairs = {(symbols[s[:k]], symbols[s[k:]]): i for s, (i, _) in normal.items() for k in range(1, len(s)) if s[:k] in symbols and s[k:] in symbols}
        self.merged = PairTable(pairs)
        self.beside = PairTable({(symbols[a], symbols[b]): 1 for s in normal for a, b in zip(s, s[1:])})

        surfaces = [bytes([int(s[1:-1], 16)]) if kind == kinds.BYTE else b"" if kind == kinds.CONTROL else " ⁇ ".encode() if kind == kinds.UNKNOWN else s.replace(MARK, " ").encode() for s, _, kind in pieces]
        self.surface_length = np.array([len(s) for s in surfaces], np.int64)
        self.surface_start = np.cumsum(self.surface_length) - self.surface_length
        self.surfaces = np.frombuffer(b"".join(surfaces), np.uint8)
        numbers = [str(i).encode() for i in range(self.size)]
        self.number_length = np.array([len(s) + 1 for s in numbers], np.int64)
        self.number_start = np.cumsum(self.number_length) - self.number_length
        self.numbers = np.frombuffer(b",".join([*numbers, b""]), np.uint8)
        rests = [self._run(n, normal) for n in range(self.longest_run)]
        self.rest_length = np.array([len(r) for r in rests], np.int64)
        self.rest_start = np.cumsum(self.rest_length) - self.rest_length
        self.rests = np.array([i for r in rests for i in r], np.int32)
        self.longest_id = normal[MARK * self.longest_run][0]

    def _check(self, model, normal: dict, other_kinds: set) -> None:
        """Raise unless words can be encoded apart and runs of marks last."""
        norm, trained = model.normalizer_spec, model.trainer_spec
        self.longest_run = max((len(s) for s in normal if not s.strip(MARK)), default=0)
        worst = min(score for _, score in normal.values())
        ok = (
            trained.model_type == trained.BPE
            and trained.byte_fallback
            and not (norm.precompiled_charsmap or norm.remove_extra_whitespaces or other_kinds or trained.treat_whitespace_as_suffix)
            and norm.add_dummy_prefix
            and norm.escape_whitespaces
            and MARK in normal
            and all(s.strip(MARK) or len(s) == 1 or score == worst for s, (_, score) in normal.items())
            and len(self._run(self.longest_run, normal)) == 1
            and all(not s.strip(MARK) or MARK not in s[1:] for s in normal)
            and all(score > worst for s, (_, score) in normal.items() if len(s) > 1 and s.strip(MARK))
        )
        if not ok:
            raise ValueError("only byte-pair models with byte fallback whose words can be encoded apart are supported")

    @staticmethod
    def _run(n: int, normal: dict) -> list[int]:
        """Ids of ``n`` marks: the leftmost two whose piece there is, until there are none."""
        parts = [1] * n
        while found := next((k for k in range(len(parts) - 1) if MARK * (parts[k] + parts[k + 1]) in normal), -1) + 1:
            parts[found - 1 : found + 1] = [parts[found - 1] + parts[found]]
        return [normal[MARK * k][0] for k in parts]

    def _rounds(self, symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Merge within segments that begin at ``begins``; what was merged into the symbol before it becomes -1."""
        out = symbols.copy()
        ends = np.append(begins[1:], len(symbols))
        long = ends - begins > 1
        begins, lengths = begins[long], (ends - begins)[long]
        place = spread(begins, lengths)
        sym = symbols[place]
        begins = np.cumsum(lengths) - lengths
        last = np.zeros(len(sym), bool)
        last[begins + lengths - 1] = True
        into = np.full(len(sym), -1, np.int32)
        inner = np.flatnonzero(~last)
        into[inner] = self.merged.find(sym[inner], sym[inner + 1])
        while len(sym):
            rank = np.where(into >= 0, self.rank[into], _NONE)
            # keep segments with a pair
            best = np.minimum.reduceat(rank, begins)
            alive = best < _NONE
            if not alive.all():
                stay = np.repeat(alive, lengths)
                sym, place, last, into, rank = sym[stay], place[stay], last[stay], into[stay], rank[stay]
                best, lengths = best[alive], lengths[alive]
                begins = np.cumsum(lengths) - lengths
                if not len(sym):
                    break
            hit = rank == np.repeat(best, lengths)
            # of pairs that overlap, every other from the left; a pair never reaches into another segment
            at = np.flatnonzero(hit)
            first = np.append(True, np.diff(at) > 1)
            at = at[(at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0]
            new = into[at]
            at, new = self._until_better(sym, into, begins, at, new, best, lengths)

            out[place[at]] = new
            out[place[at + 1]] = -1
            sym[at] = new
            last[at] = last[at + 1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            gone = np.add.reduceat(~keep, begins, dtype=np.int64)
            now = np.cumsum(keep)[at] - 1
            sym, place, last, into = sym[keep], place[keep], last[keep], into[keep]
            lengths = lengths - gone
            begins = np.cumsum(lengths) - lengths
            touched = np.zeros(len(sym) + 1, bool)
            touched[now] = touched[now - 1] = True  # the first place's neighbour before it is the spare one at the end
            into[now] = -1
            changed = np.flatnonzero(touched[:-1] & ~last)
            into[changed] = self.merged.find(sym[changed], sym[changed + 1])
        return out

    def _until_better(self, sym, into, begins, at, new, best, lengths):
        """The merges of each segment up to the first that makes a pair of the round's rank or a better one."""
        segment = np.searchsorted(begins, at, "right") - 1
        limit = best[segment]
        # what stands before a merged pair when its turn comes: the merge before it, if that ends there
        before = sym[np.maximum(at - 1, 0)]
        next_to = np.flatnonzero(np.append(False, np.diff(at) == 2))
        before[next_to] = new[next_to - 1]
        has_before = at > begins[segment]
        has_after = at + 2 < (begins + lengths)[segment]
        better = np.zeros(len(at), bool)
        for a, b, has in ((before, new, has_before), (new, sym[np.minimum(at + 2, len(sym) - 1)], has_after)):
            k = np.flatnonzero(has)
            made = self.merged.find(a[k], b[k])
            better[k] |= (made >= 0) & (self.rank[made] <= limit[k])
        if not better.any():
            return at, new
        # merges before which no better pair was made in their segment
        count = np.cumsum(better) - better
        base = count[np.searchsorted(segment, segment, "left")]
        stay = count == base
        return at[stay], new[stay]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words without spaces, each with its mark, one after another, and where each word begins; one more bound."""
        text = MARK + MARK.join(words.to_pylist()) if len(words) else ""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        symbols = self.of_char[points]
        cut = np.append(True, self.beside.find(symbols[:-1], symbols[1:]) < 0)
        lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        word_at = np.cumsum(lengths) - lengths
        cut[word_at] = True
        out = self._rounds(symbols, np.flatnonzero(cut))
        kept = np.flatnonzero(out >= 0)
        ids, ends = self._in_bytes(out[kept])
        return ids, np.append(0, ends)[np.append(np.searchsorted(kept, word_at), len(kept))]

    def _in_bytes(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces as the ids of their bytes, and where each symbol's ids end."""
        odd = np.flatnonzero(symbols >= self.size)
        points = symbols[odd] - self.first_unknown
        of_inner = points < 0
        points[of_inner] = self.inner[symbols[odd[of_inner]] - self.size]
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        many = np.ones(len(symbols), np.int64)
        many[odd] = width
        ids = np.repeat(symbols, many)
        start = (np.cumsum(many) - many)[odd]
        for w in range(1, 5):
            of_width = width == w
            p, at = points[of_width], start[of_width]
            lead = p if w == 1 else (0xF00 >> w & 0xFF) | p >> 6 * (w - 1)
            ids[at] = self.byte_ids[lead]
            for k in range(1, w):
                ids[at + k] = self.byte_ids[0x80 | p >> 6 * (w - 1 - k) & 0x3F]
        return ids, np.cumsum(many)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (null: none), and where each text begins; one more bound at the end."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if MARK.encode() in buffer_of(texts)[1]:
            texts = pc.replace_substring(texts, MARK, " ")
        parts = pc.split_pattern(texts, " ")
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False), out=bounds[1:])
        coded = parts.flatten().dictionary_encode()
        codes, vocabulary = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        empty = pc.index(vocabulary, pa.scalar("", vocabulary.type)).as_py()
        ids, at = self.words(vocabulary)
        length = np.diff(at)
        if empty < 0:
            start, many = at[codes], length[codes]
            return ids[spread(start, many)], np.append(0, np.cumsum(many))[bounds]

        # an empty part is one mark more for the run that ends before the next word, to which a word's bare mark belongs
        begins_text = np.zeros(len(codes), bool)
        begins_text[bounds[:-1]] = True
        blank = codes == empty
        new_run = blank & (begins_text | ~np.append(False, blank[:-1]))
        run_of = np.cumsum(new_run) - 1
        run_length = np.bincount(run_of[blank], minlength=int(new_run.sum()))
        run_at = np.flatnonzero(new_run)
        follower = run_at + run_length
        within = np.append(begins_text, True)[follower] == False  # noqa: E712
        bare = np.zeros(len(run_at), bool)
        after = codes[follower[within]]
        bare[within] = ids[at[after]] == self.mark
        # the empty text is a lone part that has no mark at all
        nothing = (run_length == 1) & begins_text[run_at] & np.append(begins_text, True)[follower]
        marks = np.where(nothing, 0, run_length + bare)

        skip = np.zeros(len(codes), np.int64)
        skip[follower[bare]] = 1
        start, many = at[codes] + skip, length[codes] - skip
        full, rest = marks // self.longest_run, marks % self.longest_run
        tail = self.rest_length[rest]
        many[blank] = 0
        many[run_at] = full + tail
        # a run's longest pieces are copied from behind all words' ids, with room for its rest
        start[run_at] = len(ids)
        source = np.append(ids, np.full(int(many[run_at].max(initial=0)), self.longest_id, np.int32))
        flat = source[spread(start, many)]
        ends = np.cumsum(many)
        flat[spread(ends[run_at] - tail, tail)] = self.rests[spread(self.rest_start[rest], tail)]
        return flat, np.append(0, ends)[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each document's ids."""
        length = self.surface_length[ids]
        data = self.surfaces[spread(self.surface_start[ids], length)].tobytes()
        at = np.append(0, np.cumsum(length))[bounds].tolist()
        found = [data[a:b] for a, b in zip(at, at[1:])]
        return [(x[1:] if x.startswith(b" ") else x).decode("utf-8", "replace").encode() for x in found]

    def written_out(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The decimal ids of each document, joined by commas."""
        length = self.number_length[ids]
        data = self.numbers[spread(self.number_start[ids], length)].tobytes()
        at = np.append(0, np.cumsum(length))[bounds].tolist()
        return [data[a : b - 1] if b > a else b"" for a, b in zip(at, at[1:])]


_ARROW = {"ids": pa.list_(pa.int32()), "decoded": pa.string(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def _coded(path: str, names: list[str]):
    def digest(texts: list[bytes]) -> list[str]:
        return [hashlib.sha256(x).hexdigest() for x in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in slices(batches, most=SLICE_BYTES):
            ids, bounds = c.encode(batch.column("text"))
            texts = c.decode(ids, bounds) if {"decoded", "decoded_sha256"} & set(names) else []
            found = {
                "ids": lambda: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())),
                "decoded": lambda: pa.array([x.decode() for x in texts], pa.string()),
                "n_tokens": lambda: pa.array(np.diff(bounds)),
                "ids_sha256": lambda: pa.array(digest(c.written_out(ids, bounds)), pa.string()),
                "decoded_sha256": lambda: pa.array(digest(texts), pa.string()),
            }
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(found[n]() for n in names)], ["doc_id", *names])

    return run


def _columns(docs: DataFrame, path: str, kinds: dict[str, str]) -> DataFrame:
    ddl = ", ".join(f"{n} {k}" for n, k in kinds.items())
    return docs.select("doc_id", "text").mapInArrow(_coded(path, list(kinds)), f"doc_id long, {ddl}")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of each row's text."""
    return _columns(docs, path, {"ids": "array<int>"})


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and what they decode to."""
    return _columns(docs, path, {"ids": "array<int>", "decoded": "string"})


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of what they decode to."""
    return _columns(docs, path, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), model_path())


QUERIES = {"op12_sentence_pieces": op12_sentence_pieces}
SQL: dict[str, str] = {}
