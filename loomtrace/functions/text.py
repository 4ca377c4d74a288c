"""Column functions over text, time and ids."""

from __future__ import annotations

from pyspark.sql import functions as F


def title(text):
    """Stripped, first line, at most 100 characters."""
    return F.substring(F.split(F.trim(text), "\n")[0], 1, 100)


def json_string(text):
    """A JSON string of ASCII characters alone: quotes and control characters escaped, others by their UTF-16 units; null is null."""
    plain = F.to_json(F.array(text.cast("string")))
    plain = F.substring(plain, 2, F.length(plain) - 2)
    # units of four hex digits, as they lie in big-endian UTF-16
    units = F.regexp_extract_all(F.lower(F.hex(F.encode(plain, "UTF-16BE"))), F.lit("(.{4})"), 1)
    escaped = F.array_join(F.transform(units, lambda u: F.when(u < "0080", F.char(F.conv(u, 16, 10).cast("long"))).otherwise(F.concat(F.lit("\\u"), u))), "")
    return F.when(text.isNull(), "null").when(plain.rlike("^[\\x00-\\x7F]*$"), plain).otherwise(escaped)


def stable_id(*parts):
    """First 32 hex digits of SHA-256 over the parts as a JSON array of strings in ASCII."""
    inner = F.concat_ws(", ", *[json_string(p) for p in parts])
    return F.substring(F.sha2(F.concat(F.lit("["), inner, F.lit("]")), 256), 1, 32)


#: The form of times (a fixed value): date, time, fraction and zone.
_RFC_3339 = r"^(\d{4}-\d{2}-\d{2})[Tt](\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?([Zz]|[+-]\d{2}:\d{2})$"


def _strict(text):
    """Whole seconds since 1970 and the nine digits of a second of an RFC 3339 time, and whether it is one."""
    part = lambda n: F.regexp_extract(text, _RFC_3339, n)
    zone = F.upper(part(4))
    known = (zone == "Z") | (zone != "-00:00") & (F.substring(zone, 2, 2) <= "23") & (F.substring(zone, 5, 2) <= "59")
    # offsets are taken off here, as zones reach no further than 18 hours
    minutes = F.when(zone == "Z", 0).otherwise(F.concat(F.substring(zone, 1, 1), F.substring(zone, 2, 2)).try_cast("int") * 60 + F.concat(F.substring(zone, 1, 1), F.substring(zone, 5, 2)).try_cast("int"))
    at = F.unix_seconds(F.try_to_timestamp(F.concat(part(1), F.lit("T"), part(2), F.lit("Z")))) - minutes * 60
    return at, F.rpad(part(3), 9, "0"), text.rlike(_RFC_3339) & known & (at >= 0)


def strict_nanos(text):
    """Nanoseconds since 1970 of an RFC 3339 time with a known zone and up to nine digits of a second, from 1970 to where 64 bits end (2262), else null."""
    at, digits, sound = _strict(text)
    return F.when(sound, F.try_add(F.try_multiply(at, F.lit(1_000_000_000)), digits.try_cast("long")))


def strict_micros(text):
    """As ``strict_nanos``, whole microseconds, of any year."""
    at, digits, sound = _strict(text)
    return F.when(sound, at * 1_000_000 + F.substring(digits, 1, 6).try_cast("long"))


def nanos_string(micros):
    """RFC 3339 in UTC with nine fractional digits."""
    seconds = F.floor(micros / F.lit(1_000_000)).cast("long")
    day, rest = F.floor(seconds / F.lit(86400)).cast("int"), F.pmod(seconds, F.lit(86400)).cast("int")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    date = F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string")
    fraction = F.lpad((F.pmod(micros, F.lit(1_000_000)) * 1000).cast("string"), 9, "0")
    return F.concat(date, F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest % 3600 / 60)), F.lit(":"), two(rest % 60), F.lit("."), fraction, F.lit("Z"))


def chunks(text, size: int, overlap: int):
    """Array of (start, chunk): windows of ``size`` characters, ``overlap`` shared; the last ends with the text; none of a blank text."""
    n = F.length(text)
    step = size - overlap
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / F.lit(step)).cast("int"))
    made = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * step).alias("start"), F.substring(text, i * step + 1, F.lit(size)).alias("chunk")))
    return F.when(F.trim(text) != "", made).otherwise(F.array().cast("array<struct<start:int,chunk:string>>"))


#: Ordered: the first whose words occur names the purpose (fixed values).
PURPOSES = [("abuse", "idiot|stupid|moron|scum|trash"), ("english", "the|and|of"), ("german", "der|die|und"), ("french", "les|est|une"), ("spanish", "los|las|del")]


def purpose(text):
    out = F.lit("other")
    for name, words in reversed(PURPOSES):
        out = F.when(F.lower(text).rlike(rf"(^|[^\p{{L}}])({words})($|[^\p{{L}}])"), name).otherwise(out)
    return out
