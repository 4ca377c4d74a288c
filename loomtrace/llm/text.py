"""Splitting whole texts into words, a batch of documents at a time.

A batch's texts lie in one buffer. ``bytes.translate`` lowers letters and turns
separators into spaces for all of them at once, Arrow splits at white space and
numbers the distinct words, and numpy works on the numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 12 << 20


def _table(lower: bool, separators: bytes) -> bytes:
    out = bytearray(range(256))
    if lower:
        for c in range(65, 91):
            out[c] = c + 32
    for c in separators:
        out[c] = 32
    return bytes(out)


#: Words are runs of anything but space and \t \n \v \f \r.
PLAIN = _table(False, b"")
LOWER = _table(True, b"")
#: Words are runs of digits, letters and non-ASCII characters.
ALNUM = _table(True, bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


#: Marks that may be split from the letter before them.
MARKS = b".,!?;:"
_LETTER = np.array([97 <= c <= 122 for c in range(256)])
_MARK = np.array([c in MARKS for c in range(256)])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most`` bytes of text; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        if size.sum() <= most:
            yield batch
            continue
        at, total = 0, 0
        for i, n in enumerate(size.tolist()):
            if total and total + n > most:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        yield batch.slice(at)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, bytes]:
    """Where each text begins (one more bound at the end) in the bytes of all; null is empty."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    kind = np.int64 if wide else np.int32
    if not len(texts):
        return np.zeros(1, kind), b""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(len(texts) + 1, kind), b""
    return offsets - offsets[0], data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes()


class Words:
    """Words of a batch: ``codes`` in order, ``bounds`` of documents in it, ``vocabulary`` by code (Arrow strings)."""

    def __init__(self, texts: pa.Array, table: bytes = PLAIN, split: bool = False):
        """``split``: MARKS after a letter a-z begin a word of their own."""
        n = len(texts)
        offsets, data = buffer_of(texts)
        if table is not PLAIN:
            data = data.translate(table)
        if split:
            x = np.frombuffer(data, np.uint8)
            at = np.flatnonzero(_MARK[x[1:]] & _LETTER[x[:-1]]) + 1 if len(x) else np.zeros(0, np.int64)
            data = np.insert(x, at, 32).tobytes()
            # a text that begins with a mark leaves the space to the text before it
            offsets = offsets + np.searchsorted(at, offsets, "right")
        plain = pa.StringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data))
        parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(plain))
        values = parts.flatten()
        bounds = np.zeros(n + 1, np.int64)
        np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False), out=bounds[1:])
        full = pc.binary_length(values).to_numpy(zero_copy_only=False) > 0
        if not full.all():
            values = values.filter(pa.array(full))
            bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
        coded = values.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.vocabulary = coded.dictionary
        self.bounds = bounds
        self.counts = np.diff(bounds)

    def strings(self) -> list[str]:
        return self.vocabulary.to_numpy(zero_copy_only=False).tolist()


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each pair, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
