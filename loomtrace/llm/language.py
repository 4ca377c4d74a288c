"""Language ID: a bidirectional gated recurrent network over bytes.

A text's bytes, ASCII letters lower-cased, are read in segments of ``SEGMENT``
bytes, across words and marks. Two gated recurrent networks read a segment from
either side; at every byte their joint state gives log-probabilities of the
languages. A document pools those of all its bytes: the mean, normalized.

The weights are trained here in numpy by backpropagation through time, in one
task, on at most about ``SAMPLE_ROWS`` distinct labelled texts, whole ones; the bound
is a parameter, and the model's size doesn't depend on the input. The last bytes of
a text are learned as the end of a full segment.

Cases: a null text, or one without a letter, is ``und`` with score 0, as is every
text when no row has a language to learn from. Rows with null text or lang
aren't learned from. Repeated rows get equal results. Other columns aren't read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.shared import crc_remainder, held_out, table
from loomtrace.llm.text import LOWER, buffer_of, slices

HIDDEN, SEGMENT = 16, 32
SAMPLE_ROWS = 3000
STEPS, BATCH, RATE = 450, 384, 0.02
#: Segments read side by side, and text read at once (a longer text is read whole).
ABREAST, SLICE_BYTES = 1024, 4 << 20


def segments(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, begin and length of each segment of texts between offsets."""
    size = np.diff(offsets)
    n = -(-size // SEGMENT)
    doc = np.repeat(np.arange(len(size)), n)
    begin = offsets[doc] + SEGMENT * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
    return doc, begin, np.minimum(SEGMENT, offsets[doc + 1] - begin)


def initial(n_out: int, rng) -> dict[str, np.ndarray]:
    """f and b: the forward and the backward network; x: a byte's part of the gates (update, reset, candidate), u: the state's."""
    p = {"o": rng.normal(0, 0.1, (2 * HIDDEN, n_out)), "c": np.zeros(n_out)}
    for d in "fb":
        p[d + "x"] = rng.normal(0, 0.2, (256, 3 * HIDDEN))
        p[d + "u"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _squashed(x: np.ndarray) -> np.ndarray:
    """Softsign: from -1 to 1 as tanh, at a third of its cost. Gates are (1 + softsign) / 2."""
    return x / (1 + np.abs(x))


def _read(x: np.ndarray, wx: np.ndarray, wu: np.ndarray, kept: list | None = None) -> np.ndarray:
    """States after each byte of x (places by segments), in reading order: (places, HIDDEN, segments)."""
    length, n = x.shape
    wx, wu, half = np.ascontiguousarray(wx.T), np.ascontiguousarray(wu.T), wx.dtype.type(0.5)
    h = np.zeros((HIDDEN, n), wx.dtype)
    out = np.empty((length, HIDDEN, n), wx.dtype)
    for t in range(length):
        a = wx.take(x[t], axis=1, mode="clip")
        s = wu @ h
        gates = _squashed(a[: 2 * HIDDEN] + s[: 2 * HIDDEN])
        gates += 1
        gates *= half
        z, r, s = gates[:HIDDEN], gates[HIDDEN:], s[2 * HIDDEN :]
        new = _squashed(a[2 * HIDDEN :] + r * s)
        if kept is not None:
            kept.append((h, z, r, new, s))
        h = new + z * (h - new)
        out[t] = h
    return out


def log_probabilities(p: dict, x: np.ndarray, kept: dict | None = None) -> np.ndarray:
    """(length, languages, segments) of x (segments by length): at every byte, the log-probability of each language."""
    x = np.ascontiguousarray(x.T, np.intp)
    f = _read(x, p["fx"], p["fu"], None if kept is None else kept.setdefault("f", []))
    b = _read(x[::-1], p["bx"], p["bu"], None if kept is None else kept.setdefault("b", []))[::-1]
    o = p["o"].T
    y = o[:, :HIDDEN] @ f + o[:, HIDDEN:] @ b + p["c"][:, None]
    y -= y.max(1, keepdims=True)
    y -= np.log(np.exp(y).sum(1, keepdims=True))
    if kept is not None:
        kept["h"] = np.concatenate([f, b], 1)
    return y


def gradients(p: dict, x: np.ndarray, label: np.ndarray) -> tuple[dict, float]:
    """Of the mean cross-entropy over all bytes, by backpropagation through time."""
    kept: dict = {}
    y = log_probabilities(p, x, kept)
    length, _, n = y.shape
    d = np.exp(y)
    loss = -y[:, label, np.arange(n)].mean()
    d[:, label, np.arange(n)] -= 1
    d /= length * n
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["o"] = np.einsum("thn,tkn->hk", kept["h"], d, optimize=True)
    g["c"] = d.sum((0, 2))
    dh = p["o"] @ d
    for name, part, order in (("f", dh[:, :HIDDEN], range(length)), ("b", dh[::-1, HIDDEN:], range(length - 1, -1, -1))):
        wu, carry = p[name + "u"], np.zeros((HIDDEN, n), d.dtype)
        places, seen = list(order), []
        for t in reversed(range(length)):
            before, z, r, new, s = kept[name][t]
            out = part[t] + carry
            slope = lambda gate: (1 - np.abs(2 * gate - 1)) ** 2 / 2
            dz = out * (before - new) * slope(z)
            dn = out * (1 - z) * (1 - np.abs(new)) ** 2
            dr = dn * s * slope(r)
            seen.append(np.concatenate([dz, dr, dn]))
            state = np.concatenate([dz, dr, dn * r])
            g[name + "u"] += before @ state.T
            carry = out * z + wu @ state
        byte = x.T[places[::-1]].ravel()
        for k, row in enumerate(np.stack(seen, 1).reshape(3 * HIDDEN, -1)):
            g[name + "x"][:, k] = np.bincount(byte, row, 256)
    return g, float(loss)


def train(rows: list[tuple[str, str]], steps: int = STEPS, seed: int = 11) -> dict | None:
    """The network for (text, language) rows; null without any. Languages are shown alike, as far as rows go."""
    rng = np.random.default_rng(seed)
    parts: dict[str, list[np.ndarray]] = {}
    for text, lang in sorted(rows):
        data = np.frombuffer(text.encode().translate(LOWER), np.uint8)
        if len(data) < SEGMENT:
            data = np.resize(data, SEGMENT if any(map(str.isalpha, text)) else 0)  # a short text, again and again
        _, begin, _ = segments(np.array([0, len(data)]))
        begin = np.minimum(begin, len(data) - SEGMENT)
        parts.setdefault(lang, []).append(data[begin[:, None] + np.arange(SEGMENT)])
    known = {k: np.concatenate(v) for k, v in sorted(parts.items())}
    known = {k: v for k, v in known.items() if len(v)}
    if not known:
        return None
    langs, x = list(known), np.concatenate(list(known.values()))
    counts = np.array([len(v) for v in known.values()])
    label = np.repeat(np.arange(len(langs)), counts)
    share = np.cumsum(np.repeat(counts**-0.5, counts))  # rarer languages are shown more often
    p = initial(len(langs), rng)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        at = np.searchsorted(share, rng.random(BATCH) * share[-1], "right").clip(0, len(label) - 1)
        g, _ = gradients(p, x[at], label[at])
        rate = RATE * (1 - step / (steps + 1)) ** 0.5
        for k in p:
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.003 * (g[k] * g[k] - v[k])
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.997**step)) + 1e-8)).astype(np.float32)
    return {"langs": langs, "p": p}


def byte_sums(p: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text between offsets, the sums over its bytes of the log-probability of each language."""
    doc, begin, length = segments(offsets)
    out = np.zeros((len(offsets) - 1, len(p["c"])))
    for size in np.unique(length).tolist():
        of = np.flatnonzero(length == size)
        for at in range(0, len(of), ABREAST):
            some = of[at : at + ABREAST]
            y = log_probabilities(p, data[begin[some][:, None] + np.arange(size)]).sum(0)
            np.add.at(out, doc[some], y.T)
    return out


def labelled(model: dict, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; und and 0 without a letter."""
    offsets, data = buffer_of(texts)
    data, offsets = np.frombuffer(data.translate(LOWER), np.uint8), offsets.astype(np.int64)
    total = byte_sums(model["p"], data, offsets)
    mean = total / np.maximum(np.diff(offsets), 1)[:, None]
    p = np.exp(mean - mean.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    letters = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    lettered = letters[offsets[1:]] > letters[offsets[:-1]]
    for i in np.flatnonzero(~lettered).tolist():  # no ASCII letter: another one?
        lettered[i] = any(map(str.isalpha, texts[i].as_py() or ""))
    return [model["langs"][b] if k else "und" for b, k in zip(p.argmax(1).tolist(), lettered.tolist())], np.where(lettered, p.max(1), 0.0)


def fit(docs: DataFrame, most: int = SAMPLE_ROWS, steps: int = STEPS) -> bytes:
    """The pickled model (of fixed size) from at most about ``most`` distinct texts with a lang whose id's crc32 mod 3 isn't 1."""
    texts = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).where(F.coalesce(crc_remainder("doc_id"), F.lit(0)) != 1)
    key = F.xxhash64("text", "lang", F.lit(3))
    n = texts.select(key.alias("key")).agg(F.approx_count_distinct("key", 0.02)).first()[0]
    if n > most:
        texts = texts.where(F.pmod(key, F.lit(1 << 40)) < int((1 << 40) * most / n))
    texts = texts.select("text", "lang").distinct()  # equal rows are one before they meet

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [pickle.dumps(train(list(zip(part["text"], part["lang"])), steps))]})

    rows = texts.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "model binary").collect()
    return bytes(rows[0][0]) if rows else pickle.dumps(None)


def identified(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, lang_pred, score of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = pickle.loads(model)
        for batch in slices(batches, most=SLICE_BYTES):
            langs, score = labelled(trained, batch.column("text")) if trained else (["und"] * batch.num_rows, np.zeros(batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op1_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identified(docs, fit(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_gru_language": op1_gru_language}
SQL: dict[str, str] = {}
