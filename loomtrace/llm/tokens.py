"""Token ids of whole texts, word by word.

A tokenizer that drops white space and case gives a text the ids of its words one
after another, and marks after a letter are a word of their own. Each worker
keeps the ids of words it has met and asks the tokenizers library only for new
ones. Where a tokenizer fails the probe in ``_drops_space``, and for slices with
what may be a special token, whole texts go to the library.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loomtrace.llm.text import LOWER, MARKS, Words, buffer_of, spread

#: Words of these letters alone are one pre-token whatever stands next to them.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_MARKED = re.compile(f"(?<=[a-z])(?=[{re.escape(MARKS.decode())}])")
_JOINED = 400
#: Words a worker remembers; beyond it it starts afresh.
REMEMBERED = 800_000
#: Text encoded at once, so that a worker's arrays stay small; a longer text is encoded whole.
SLICE_BYTES = 6 << 20
_READY: dict = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> "WordEncoder":
    """This worker's encoder for a tokenizer file."""
    if path not in _READY:
        _READY[path] = WordEncoder(path)
    return _READY[path]


class WordEncoder:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        self.by_word = self._drops_space()
        self.special = [x.content.encode() for x in self.library.get_added_tokens_decoder().values()]
        self.last = np.zeros(size, bool)
        for word, i in self.library.get_vocab().items():
            self.last[i] = word.endswith("</w>")
        self._empty()

    def _plain(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _drops_space(self) -> bool:
        """Whether ids of a text are those of its words in lower case, marks after a letter apart."""
        probes = ("a b", "Ab,\tc. d", "x\n\ny ", " é́ 1 22\r\nz!", "it's ... ok", "QUITE Upper", "a.b?!c,9:d")
        return all(self._plain(p) == [i for w in _MARKED.sub(" ", p.lower()).encode().split() for i in self._plain(w.decode())] for p in probes)

    def _empty(self) -> None:
        self.words = pa.array([], pa.string())  # in Arrow, as so many Python strings would take several times the memory
        self.start, self.length, self.hits = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, np.uint32)

    def _forget(self) -> None:
        """Forget all but the words met in most slices, less than half of REMEMBERED."""
        stay = self.hits > (np.partition(self.hits, -(REMEMBERED // 2))[-(REMEMBERED // 2)] if len(self.hits) > REMEMBERED // 2 else 0)
        words, length = self.words.filter(pa.array(stay)), self.length[stay]
        ids = self.ids[spread(self.start[stay], length)]
        self._empty()
        self._keep(words, ids, length)

    def _keep(self, words: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Remember words by their ids, one word's after another's."""
        self.words = pa.concat_arrays([self.words, words])
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.hits = np.concatenate([self.hits, np.zeros(len(words), np.int64)])
        self.ids = np.concatenate([self.ids, ids])

    def _learn(self, words: list[str]) -> None:
        """Ids of new words: letters alone go to the library many in a string, split at ends of words."""
        letters, other, kept, found, lengths = [], [], [], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for word in words:
            (letters if _LETTERS.fullmatch(word) else other).append(word)
        groups = [letters[at : at + _JOINED] for at in range(0, len(letters), _JOINED)]
        for group, got in zip(groups, self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(got.ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group):
                kept += group
                found.append(ids)
                lengths.append(np.diff(ends, prepend=0))
            else:
                other += group
        for at in range(0, len(other), _JOINED):
            group = other[at : at + _JOINED]
            got = [x.ids for x in self.library.encode_batch_fast(group, add_special_tokens=False)]
            kept += group
            found.append(np.array([i for x in got for i in x], np.uint32))
            lengths.append(np.array([len(x) for x in got], np.int64))
        self._keep(pa.array(kept, pa.string()), np.concatenate(found), np.concatenate(lengths))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (null: none), and where each text begins; one more bound at the end."""
        # a special token's string must keep its case
        if not self.by_word or any(x in buffer_of(texts)[1] for x in self.special):
            got = [x.ids for x in self.library.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)
            return np.array([i for x in got for i in x], np.uint32), bounds
        words = Words(texts, LOWER, split=True)
        if len(self.words) > REMEMBERED:
            self._forget()
        found = pc.index_in(words.vocabulary, self.words)
        rows = pc.fill_null(found, -1).to_numpy()
        if found.null_count:
            new, known = words.vocabulary.filter(found.is_null()), len(self.words)
            self._learn(new.to_pylist())
            rows = rows.copy()
            rows[rows < 0] = known + pc.index_in(new, self.words.slice(known)).to_numpy()
        self.hits[rows] += 1
        length = self.length[rows][words.codes]
        ids = self.ids[spread(self.start[rows][words.codes], length)]
        ends = np.concatenate([[0], np.cumsum(length)])
        return ids, ends[words.bounds]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same, each document followed by ``end_id``."""
    n = len(bounds) - 1
    return np.insert(ids, bounds[1:], np.full(n, end_id, np.uint32)), bounds + np.arange(n + 1)
