"""Functions that Spark has no built-in for, as vectorized UDFs over Arrow batches, and validators."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

_SPACE = re.compile(r"\s+")


def _normalized(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _SPACE.sub(" ", unicodedata.normalize("NFKC", t)).strip())


def normalized(text):
    """NFKC with white space collapsed; case is kept."""
    return F.pandas_udf(_normalized, "string")(text)


def merged(target, patch):
    """A JSON merge patch: objects merge, null deletes, anything else replaces."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merged(out.get(k), v)
    return out


def _patched(targets: pd.Series, patches: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or p is None else json.dumps(merged(json.loads(t), json.loads(p)), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for t, p in zip(targets, patches)])


def merge_patch(target, patch):
    """Canonical JSON of a document with a merge patch applied; null if either is null."""
    return F.pandas_udf(_patched, "string")(target, patch)


def _digests(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else hashlib.sha256(",".join(float(x).hex() for x in v).encode()).hexdigest())


def vector_digest(vector):
    """SHA-256 over a vector's exact hexadecimal floats."""
    return F.pandas_udf(_digests, "string")(vector)


def fitted(text: str, limit: int) -> list[str]:
    """Parts of at most ``limit`` characters that join to the text, halved near white space."""
    todo, out = [text], []
    while todo:
        part = todo.pop()
        if len(part) <= limit:
            out.append(part)
            continue
        middle = len(part) // 2
        cut = max(part.rfind(" ", 1, middle + 1), part.rfind("\n", 1, middle + 1))
        cut = cut + 1 if cut > 0 else middle
        todo += [part[cut:], part[:cut]]
    return out


def fit_parts(text, limit: int):
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else fitted(t, limit))

    return F.pandas_udf(run, "array<string>")(text)


def valid_name(column):
    """A plain name: a letter or digit, then up to 99 letters, digits, dots, dashes or underscores."""
    return F.coalesce(column.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,99}\z"), F.lit(False))


def clean_tags(tags):
    """Trimmed, without blanks, commas or tags over 80 characters, each once, sorted, at most 50."""
    kept = F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: (t != "") & ~F.contains(t, F.lit(",")) & (F.length(t) <= 80))
    return F.slice(F.array_sort(F.array_distinct(kept)), 1, 50)


def _shell(commands: pd.Series) -> pd.Series:
    import shlex

    return commands.map(lambda c: "" if c is None else shlex.join(list(c)))


def command_text(parts):
    """A command line, quoted for a shell; empty for null."""
    return F.pandas_udf(_shell, "string")(parts)


def content_text(parts):
    """The texts of an array of structs with ``text``, one after another."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["text"].isNotNull()), lambda p: p["text"]), "")


def rendered(template: str, **values):
    """A template with {name} replaced by columns; every name must occur, and none may be left."""
    out = F.lit(template)
    for name, value in values.items():
        if "{" + name + "}" not in template:
            raise ValueError(f"the template has no {name}")
        out = F.replace(out, F.lit("{" + name + "}"), value)
        template = template.replace("{" + name + "}", "")
    if re.search(r"\{\w+\}", template):
        raise ValueError("a name of the template has no value")
    return out


def softmax(scores):
    """Probabilities of an array of scores, exponents taken from the largest."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def first_best(scores):
    """Place of the largest score, from 0; the first of equals."""
    return F.array_position(scores, F.array_max(scores)) - 1


def decoded(data: bytes, encoding: str | None, limit: int) -> bytes | None:
    """A body's bytes; null if it isn't identity or one whole gzip stream, or would exceed ``limit``."""
    import zlib

    if encoding in (None, "", "identity"):
        return data if len(data) <= limit else None
    if encoding != "gzip":
        return None
    reader = zlib.decompressobj(wbits=31)
    try:
        out = reader.decompress(data, limit + 1)
    except zlib.error:
        return None
    return out if reader.eof and not reader.unused_data and len(out) <= limit else None


def decoded_body(content, encoding, limit: int):
    def run(bodies: pd.Series, encodings: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else decoded(bytes(b), e, limit) for b, e in zip(bodies, encodings)], dtype=object)

    return F.pandas_udf(run, "binary")(content, encoding)
