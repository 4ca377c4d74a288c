"""Field lineage: JSON leaves by pointer, each with its nearest description, and evidence for them in archived lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.operators.graph import dealt_anew
from loomtrace.sources.storage import written


#: Levels that are opened in one pass; what lies deeper is opened in further ones.
LEVELS = 8


def _opened(at: DataFrame) -> DataFrame:
    """owner, pointer, v, whole (not opened yet): containers one level further; empty ones and plain values as they are."""
    member = lambda m: F.struct(F.replace(F.replace(m["key"], F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")).alias("step"), m["value"].alias("v"))
    # a container is opened in its text form: numbers below it are as they are written there
    at = at.withColumn("w", F.when(F.col("whole"), F.parse_json(F.to_json("v"))))
    members = F.transform(F.map_entries(F.try_variant_get("w", "$", "map<string,variant>")), member)
    items = F.transform(F.try_variant_get("w", "$", "array<variant>"), lambda x, i: F.struct(i.cast("string").alias("step"), x.alias("v")))
    inner = at.select("owner", "pointer", "v", F.explode_outer(F.coalesce(members, items)).alias("x"))
    inside = F.col("x").isNotNull()
    return inner.select("owner", F.when(inside, F.concat("pointer", F.lit("/"), "x.step")).otherwise(F.col("pointer")).alias("pointer"), F.when(inside, F.col("x.v")).otherwise(F.col("v")).alias("v"), inside.alias("whole"))


def leaves(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, pointer, type, value (JSON text) of every leaf, however deep; empty containers and nulls are leaves.

    LEVELS at a time are opened and written once; passes go on until no container is left.
    """
    at = rows.select(F.col(key).alias("owner"), F.lit("").alias("pointer"), F.try_parse_json(column).alias("v")).where("v IS NOT NULL")
    out = None
    while True:
        at = at.withColumn("whole", F.lit(True))
        for _ in range(LEVELS):
            at = _opened(at)
        kind = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
        level = at.select("owner", "pointer", F.lower(kind).alias("type"), F.to_json("v").alias("value"))
        opens = ((F.col("type") == "object") & (F.col("value") != "{}")) | ((F.col("type") == "array") & (F.col("value") != "[]"))
        level = written(level.withColumn("opens", opens), "leaves")
        done = level.where("NOT opens").select("owner", "pointer", "type", "value")
        out = done if out is None else out.unionByName(done)
        rest = level.where("opens")
        if rest.isEmpty():
            return out.withColumnRenamed("owner", key)
        at = rest.select("owner", "pointer", F.parse_json("value").alias("v"))


def described(found: DataFrame, key: str, descriptions: DataFrame) -> DataFrame:
    """Leaves, each once, with the origin of the longest described pointer that is theirs or a parent's.

    descriptions: pointer, origin; a fixed vocabulary of fields, so it goes along as one map in which each leaf looks up
    its own prefixes. Leaves are dealt before they are compared: hardly any repeat, so combining before would only spill.
    """
    names = descriptions.where("pointer IS NOT NULL AND origin IS NOT NULL").groupBy("pointer").agg(F.max("origin").alias("origin"))
    names = names.agg(F.map_from_entries(F.collect_list(F.struct("pointer", "origin"))).alias("names"))
    rows = found.select(key, "pointer", "value").repartition(key, "pointer", "value").distinct().crossJoin(F.broadcast(names))
    parts = F.split("pointer", "/")
    said = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.try_element_at("names", F.array_join(F.slice(parts, 1, n), "/")))
    return rows.select(key, "pointer", "value", F.get(F.filter(said, lambda o: o.isNotNull()), F.lit(0)).alias("origin"))


def json_path(pointer):
    """The path of ``get_json_object`` for a JSON pointer."""
    steps = F.slice(F.split(pointer, "/"), 2, 1_000)
    plain = F.transform(steps, lambda x: F.replace(F.replace(x, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    # a number is an index
    return F.concat(F.lit("$"), F.array_join(F.transform(plain, lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("["), x, F.lit("]"))).otherwise(F.concat(F.lit("['"), x, F.lit("']")))), ""))


def resolved(line, pointer):
    """The value at a pointer of a line of JSON, as text; the digest of the line for the empty pointer; null where there is none."""
    return F.when(pointer == "", F.sha2(line, 256)).otherwise(F.call_function("get_json_object", line, json_path(pointer)))



def saved(evidence: DataFrame, lines: DataFrame) -> DataFrame:
    """Evidence (file, pointer, sources and more) as a row a source, with ``seen``: the value that the line (file, line_number, line) has there.

    A field without sources stays as a row with none.
    """
    names = [c for c in evidence.columns if c not in ("pointer", "sources")]
    rows = evidence.select(*names, F.col("pointer").alias("field"), F.explode_outer("sources").alias("s")).select(*names, "field", "s.line", F.col("s.pointer").alias("place"), "s.use")
    held = dealt_anew(lines.select("file", F.col("line_number").cast("long").alias("line"), F.col("line").alias("raw")), "file")
    return rows.join(held, ["file", "line"], "left").withColumn("seen", resolved(F.col("raw"), F.col("place"))).drop("raw")


def checked(evidence: DataFrame, lines: DataFrame, archives: DataFrame) -> DataFrame:
    """Saved evidence against archived lines, with ``state``.

    archives: the files of which there are lines. States: no source, no archive, no
    line, unresolved (the line has nothing there any more), changed, or ok.
    """
    held = dealt_anew(lines.select("file", F.col("line_number").cast("long").alias("line"), F.col("line").alias("raw")), "file")
    rows = evidence.join(dealt_anew(archives.select("file", F.lit(True).alias("archived")), "file"), "file", "left").join(held, ["file", "line"], "left")
    now = resolved(F.col("raw"), F.col("place"))
    state = (
        F.when(F.col("place").isNull(), "no source").when(F.col("archived").isNull(), "no archive").when(F.col("raw").isNull(), "no line")
        .when(now.isNull() & F.col("seen").isNotNull(), "unresolved").when(now.eqNullSafe(F.col("seen")), "ok").otherwise("changed")
    )
    return rows.withColumn("state", state).drop("raw", "archived")


def supported(found: DataFrame, key: str, checked_evidence: DataFrame) -> DataFrame:
    """Leaves (key, pointer, value) with the evidence of the nearest field at or above them: origin, sources, broken (how many of these don't hold); nulls where there is none.

    checked_evidence: key, field, origin, place, state. A leaf looks up its own prefixes, longest first.
    """
    parts = F.split("pointer", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = found.select(key, "pointer", "value", F.explode(prefixes).alias("field"))
    sound = F.col("state").isin("ok", "no source")
    by = checked_evidence.groupBy(key, "field", "origin").agg(F.count("place").alias("sources"), F.count_if(~sound).alias("broken"))
    named = rows.join(dealt_anew(by, key, "field"), [key, "field"], "left")
    best = F.max(F.when(F.col("origin").isNotNull(), F.struct(F.length("field").alias("n"), "origin", "sources", "broken")))
    return named.groupBy(key, "pointer", "value").agg(best.alias("b")).select(key, "pointer", "value", "b.origin", "b.sources", "b.broken")
