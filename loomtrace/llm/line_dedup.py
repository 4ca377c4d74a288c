"""Repeated passages by winnowing over line hashes.

Lines with words are hashed. The window of a line is the shortest run of lines
from it that has at least ``least_words`` words; its least line hash is its
fingerprint, so a passage shared by two texts, that long or longer, shares a
fingerprint. A line is sent once for all windows in a row that pick it, with the
lines of these windows and around them up to ``least_words`` words. Lines picked at
one place only drop out; of the others the windows are told apart again and joined
on fingerprint and content with the first place of each in (doc_id, line) order,
each match is extended line by line both ways, and the later run is deleted. A
passage that a text repeats at once keeps its first copy.

A match that goes on further than the lines around a window has windows of its own
there.

Cases: null and empty texts, and lines without words, stay as they are; lines
are compared with white space collapsed. Rows equal in doc_id and text are one
document and stay; equal texts under different ids are repeats of the smallest
(a null id sorts first). An empty table gives no rows. Other columns stay,
but for ones named like an output or working column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.shared import added, table, without, written
from loomtrace.llm.text import slices
from loomtrace.operators.graph import dealt_anew

LEAST_WORDS = 50

#: A picked line: the first and last window that picks it, the first line sent, and of those the digests (16 bytes each) and words.
_PICK = "id long, text_key long, fingerprint long, first_window int, last_window int, first_line int, digests binary, words array<int>"
_WINDOW = "id long, text_key long, start int, end int, fingerprint long, window binary, `left` array<long>, `right` array<long>"


def _schema(*fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([("id", pa.int64()), ("text_key", pa.int64()), *fields])


_PICK_ARROW = _schema(("fingerprint", pa.int64()), ("first_window", pa.int32()), ("last_window", pa.int32()), ("first_line", pa.int32()), ("digests", pa.binary()), ("words", pa.list_(pa.int32())))
_WINDOW_ARROW = _schema(("start", pa.int32()), ("end", pa.int32()), ("fingerprint", pa.int64()), ("window", pa.binary()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64())))


def _lines(text: str) -> list[tuple[int, list[bytes]]]:
    """Place and words of each line that has words."""
    return [(i, parts) for i, line in enumerate(text.split("\n")) if (parts := line.encode().split())]


def _hash(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def picks_of(text: str, least_words: int) -> list[tuple]:
    """The picked lines of a text (the columns of ``_PICK``); lines are counted among those with words."""
    import xxhash

    lines = _lines(text)
    digests = [xxhash.xxh3_128_digest(b" ".join(parts)) for _, parts in lines]
    words = [len(parts) for _, parts in lines]
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(lines)
    ends = (np.searchsorted(total, total[:-1] + least_words) - 1).tolist()  # last line of the window; n or more: none
    hashes = list(map(_hash, digests))
    runs: list[list[int]] = []  # picked line, first and last window that picks it
    for i in range(n):
        if ends[i] >= n:
            break
        at = min(range(i, ends[i] + 1), key=hashes.__getitem__)
        if runs and runs[-1][0] == at:
            runs[-1][2] = i
        else:
            runs.append([at, i, i])
    out = []
    for at, a, b in runs:
        low = int(np.searchsorted(total, total[a] - least_words, "right"))
        high = min(n, int(np.searchsorted(total, total[ends[b] + 1] + least_words, "left")))
        out.append((hashes[at], a, b, low, b"".join(digests[low:high]), words[low:high]))
    return out


def windows_of(first_window: int, last_window: int, first_line: int, digests: bytes, words: list[int], least_words: int) -> list[tuple]:
    """start, end, window, left, right of each window that picks a line: content hash, and the line hashes on either side."""
    import xxhash

    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    hashes = [_hash(digests[16 * k :]) for k in range(n)]
    out = []
    for i in range(first_window - first_line, last_window - first_line + 1):
        e = int(np.searchsorted(total, total[i] + least_words)) - 1
        before = int(np.searchsorted(total, total[i] - least_words, "right"))  # first line of the left context
        after = min(n, int(np.searchsorted(total, total[e + 1] + least_words, "left")))
        out.append((i + first_line, e + first_line, xxhash.xxh3_128_digest(digests[16 * i : 16 * e + 16]), hashes[before:i][::-1], hashes[e + 1 : after]))
    return out


def picks(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row a picked line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pc.fill_null(batch.column("text"), "").to_numpy(zero_copy_only=False).tolist()
            found = [picks_of(t, least_words) for t in texts]
            n = np.array([len(x) for x in found])
            of = pa.array(np.repeat(np.arange(len(n)), n))
            columns = list(zip(*(x for rows in found for x in rows))) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("id").take(of), batch.column("text_key").take(of), *(pa.array(list(c), f.type) for c, f in zip(columns, list(_PICK_ARROW)[2:]))], schema=_PICK_ARROW)

    return keyed(docs).select("id", "text_key", "text").mapInArrow(run, _PICK)


def windows(found: DataFrame, least_words: int) -> DataFrame:
    """One row a window of picked lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("first_window", "last_window", "first_line", "digests", "words")
            rows = [windows_of(*x, least_words) for x in zip(*(batch.column(n).to_pylist() for n in names))]
            n = np.array([len(x) for x in rows], np.int64)
            of = pa.array(np.repeat(np.arange(len(n)), n))
            start, end, window, left, right = list(zip(*(x for part in rows for x in part))) or [()] * 5
            columns = {"start": start, "end": end, "window": window, "left": left, "right": right}
            kept = {c: batch.column(c).take(of) for c in ("id", "text_key", "fingerprint")}
            yield pa.RecordBatch.from_arrays([kept[f.name] if f.name in kept else pa.array(list(columns[f.name]), f.type) for f in _WINDOW_ARROW], schema=_WINDOW_ARROW)

    return found.mapInArrow(run, _WINDOW)


def keyed(docs: DataFrame) -> DataFrame:
    """Add what names a document: id (doc_id, null as the smallest) and text_key."""
    return docs.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn("text_key", F.xxhash64("text"))


def _agreeing(a: str, b: str):
    """How many leading elements of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, F.lit(False)).cast("int")
    return F.when(stop > 0, stop - 1).otherwise(F.size(same))


def repeated_runs(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """id, text_key, runs: the later runs of lines to delete (begin, end inclusive, among lines with words) of each document that has any."""
    rows = written(picks(docs, least_words), "line-picks")
    places = rows.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    met = rows.join(dealt_anew(places, "fingerprint"), "fingerprint", "left_semi")
    met = written(windows(met, least_words), "line-windows")
    place = F.struct("id", "text_key", "start")
    first = met.groupBy("fingerprint", "window").agg(F.min(place).alias("place"), F.count("*").alias("n")).where("n > 1").select("fingerprint", "window", "place")
    whole = written(met.join(dealt_anew(first, "fingerprint"), ["fingerprint", "window"]), "line-matches")
    origin = whole.where(F.col("place") == place).groupBy("fingerprint", "window").agg(F.first(F.struct("end", "left", "right")).alias("o"))
    later = whole.where(place > F.col("place")).join(dealt_anew(origin, "fingerprint"), ["fingerprint", "window"])
    same = (F.col("id") == F.col("place.id")) & (F.col("text_key") == F.col("place.text_key"))
    begin = F.col("start") - _agreeing("left", "o.left")
    begin = F.when(same, F.greatest(begin, F.col("o.end") + 1)).otherwise(begin)
    runs = later.select("id", "text_key", begin.alias("begin"), (F.col("end") + _agreeing("right", "o.right")).alias("end")).where("begin <= end")
    return runs.groupBy("id", "text_key").agg(F.collect_set(F.struct("begin", "end")).alias("runs"))


def _removal(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            clean, n_lines, n_removed = [], [], []
            for text, runs in zip(batch.column("text").to_numpy(zero_copy_only=False).tolist(), batch.column("runs").to_pylist()):
                if text is None:
                    clean.append(None)
                    n_lines.append(0)
                    n_removed.append(0)
                    continue
                lines = text.split("\n")
                full = [i for i, line in enumerate(lines) if line.encode().split()]
                n_lines.append(len(full))
                if not runs:
                    clean.append(text)
                    n_removed.append(0)
                    continue
                gone = {k for x in runs for k in range(x["begin"], x["end"] + 1)}
                n_removed.append(len(gone))
                drop = {full[k] for k in gone}
                # blank lines inside a deleted run go with it
                for k in gone:
                    if k + 1 in gone:
                        drop.update(range(full[k], full[k + 1]))
                clean.append("\n".join(line for i, line in enumerate(lines) if i not in drop))
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(clean, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], [*names, "clean_text", "n_lines", "n_removed"])

    return run


def deduplicated(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The columns of ``docs``, clean_text, n_lines (with words) and n_removed."""
    docs = without(docs, {"clean_text", "n_lines", "n_removed", "id", "text_key", "runs"})
    names = docs.columns
    runs = repeated_runs(docs, least_words)
    return keyed(docs).join(runs, ["id", "text_key"], "left").select(*[f"`{c}`" for c in names], "runs").mapInArrow(_removal(names), added(docs, "clean_text string, n_lines long, n_removed long"))


def op8_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op8_line_winnowing": op8_line_winnowing}
SQL: dict[str, str] = {}
