"""Line-first quality rules.

Each line is judged by itself: shouting, symbols, navigation, missing final
punctuation and boilerplate remove it. What is left is the cleaned text; a
document that loses more than half of the characters of its words, for whatever
reason, or has too few words left is rejected, and so is one that fails the base
rule.

Words are runs of anything but space and \\t \\n \\v \\f \\r. Cases: null and empty
texts have no words and fail the base rule; very long lines and texts are judged
whole; repeated rows are judged alike; an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from loomtrace.llm.shared import table
from loomtrace.llm.text import Words, slices

LEAST_WORDS, MOST_REPEATED = 50, 50
#: Share of the characters of words that may be lost with removed lines.
MOST_LOST = 0.5

_SYMBOLS = re.compile("[#*$%&|<>]")
_MARKS = re.compile(r"[#*$%&|<>{}\[\]~^=\\_@+]|!!|\?\?")
_NAVIGATION = re.compile(r"(?:^|\s)(?:\||»|«|›|‹|•|·|→|←|>>|<<|/|::)(?=\s|$)")
_ENDED = re.compile(r"[.!?…。！？؟।:;][\"'”’»)\]}]*\s*$")
#: Phrases of licence, cookie and site notices.
_BOILERPLATE = re.compile(
    r"all rights reserved|licensed under|creative commons|apache license|mit license|general public license|cc by(?:-\w+)*|copyright(?: ©| \(c\))?(?: \d{4})?|© ?\d{4}|\(c\) \d{4}"
    r"|terms of (?:use|service)|privacy policy|cookie policy|(?:accept|use|uses) cookies|lorem ipsum|enable javascript|subscribe to|sign up for|click here|read more|share on|follow us|powered by",
    re.IGNORECASE | re.ASCII,
)
#: What a text has in lower case if it has a phrase (fixed values).
_HINTS = (
    "all rights reserved", "licensed under", "creative commons", "apache license", "mit license", "general public license", "cc by", "copyright", "©", "(c) ", "terms of ", "privacy policy",
    "cookie policy", " cookies", "lorem ipsum", "enable javascript", "subscribe to", "sign up for", "click here", "read more", "share on", "follow us", "powered by",
)
_UPPER, _LETTERS, _BEYOND = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)]), re.compile("[^\x00-\x7f]+")
#: A notice is a line of which its phrases are at least this share of words; a sentence that has one of them is none.
_NOTICE_SHARE = 0.25

_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_lines_removed long, lost double, reason string, clean_text string"


def _shouts(line: str) -> bool:
    data, beyond = line.encode("ascii", "ignore"), "".join(_BEYOND.findall(line))
    upper = len(data) - len(data.translate(None, _UPPER)) + sum(map(str.isupper, beyond))
    return upper > 8 and upper > 0.6 * (len(data) - len(data.translate(None, _LETTERS)) + sum(map(str.isalpha, beyond)))


def line_verdict(line: str, n_words: int, noticed: bool = True) -> str | None:
    """Why a line with words goes: boilerplate, shouting, symbols, navigation or punctuation; null if it stays.

    ``noticed``: whether its text has a phrase of notices at all.
    """
    if noticed and sum(len(m[0].split()) for m in _BOILERPLATE.finditer(line)) >= _NOTICE_SHARE * n_words:
        return "boilerplate"
    if n_words >= 3:
        if len(_NAVIGATION.findall(line)) >= max(2, 0.2 * n_words):
            return "navigation"
        if len(_MARKS.findall(line)) >= 0.3 * n_words:
            return "symbols"
        if _shouts(line):
            return "shouting"
    if not _ENDED.search(line) and n_words < 8:
        return "punctuation"
    return None


def repeated_words(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each document, how many words lie in a 3-word window that it has twice or more."""
    n = len(codes)
    out = np.zeros(len(counts), np.int64)
    if n < 3:
        return out
    doc = np.repeat(np.arange(len(counts)), counts)
    whole = doc[2:] == doc[:-2]
    at = np.flatnonzero(whole)
    c = codes.astype(np.int64)
    # pairs get a number, then (document, pair, word) does; both exact
    _, pair = np.unique((c[:-1] << 32) | c[1:], return_inverse=True)
    _, triple = np.unique((pair[at] << 31) | c[at + 2], return_inverse=True)
    _, inverse, times = np.unique((triple << 24) | doc[at], return_inverse=True, return_counts=True)
    again = at[times[inverse] > 1]
    marked = np.zeros(n, bool)
    for k in range(3):
        marked[again + k] = True
    np.add.at(out, doc[marked], 1)
    return out


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = pc.fill_null(batch.column("text"), "")
        words = Words(texts)
        length = pc.utf8_length(words.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
        chars = np.concatenate([[0], np.cumsum(length[words.codes])])[words.bounds]
        repeats = repeated_words(words.codes, words.counts)
        rows = []
        for text, n_words, n_chars, n_repeat in zip(texts.to_numpy(zero_copy_only=False).tolist(), words.counts.tolist(), np.diff(chars).tolist(), repeats.tolist()):
            base_failed = n_words < LEAST_WORDS or 100 * n_repeat > MOST_REPEATED * n_words
            seen, dup, n_lines, removed, lost, left, keep = set(), 0, 0, 0, 0, 0, []
            low = text.lower()
            noticed = any(x in low for x in _HINTS)
            for line in text.split("\n"):
                parts = line.encode().split()
                if not parts:
                    keep.append(line)
                    continue
                n_lines += 1
                dup += line in seen
                seen.add(line)
                why = line_verdict(line, len(parts), noticed)
                if why is None:
                    keep.append(line)
                    left += len(parts)
                    continue
                removed += 1
                lost += sum(map(len, map(bytes.decode, parts)))
            share = lost / max(1, n_chars)
            reason = "base" if base_failed else "lost" if share > MOST_LOST else "short" if left < LEAST_WORDS // 2 else None
            rows.append((n_words, n_chars, len(_SYMBOLS.findall(text)), dup, n_repeat, base_failed, reason is None, n_lines, removed, share, reason, "\n".join(keep)))
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.float64(), pa.string(), pa.string()]
        columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)]
        names = [x.split()[0] for x in _OUT.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], names)


def line_first(docs: DataFrame) -> DataFrame:
    """One row a document: counts, the base verdict, the lines' verdict and the cleaned text."""
    return docs.select("doc_id", "text").mapInArrow(judged, _OUT)


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_first(table(spark, sf_dir, "documents")).drop("clean_text")


QUERIES = {"op2_line_quality": op2_line_quality}
SQL: dict[str, str] = {}
