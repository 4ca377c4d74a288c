"""Replays, contexts, surrogate names and predictions for review and training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.operators.ordering import row_numbers


def replayed(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests (request) with what saved attempts say (request, attempt, ok, answer): the one success's answer, an error if there are two, failed or open."""
    r = responses.groupBy("request").agg(F.count("*").alias("attempts"), F.count_if("ok").alias("successes"), F.min_by("answer", F.when(F.col("ok"), F.col("attempt"))).alias("answer"))
    j = requests.join(r, "request", "left")
    state = F.when(F.col("attempts").isNull(), "open").when(F.col("successes") > 1, "duplicate success").when(F.col("successes") == 1, "done").otherwise("failed")
    return j.select("request", F.coalesce("attempts", F.lit(0)).alias("attempts"), state.alias("state"), F.when(state == "done", F.col("answer")).alias("answer"))


def listed(kinds: dict[str, DataFrame]) -> DataFrame:
    """Artifacts of several kinds (id, document: JSON) as one list, with revision and size of each; what isn't a sound document is listed with the error."""
    rows = None
    for kind, df in kinds.items():
        part = df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "document")
        rows = part if rows is None else rows.unionByName(part)
    v = F.try_parse_json("document")
    revision = F.try_variant_get(v, "$.revision", "bigint")
    error = F.when(v.isNull(), "not JSON").when(revision.isNull(), "no revision").when(~F.try_variant_get(v, "$.id", "string").eqNullSafe(F.col("id")), "another id")
    return rows.select("kind", "id", error.alias("error"), F.when(error.isNull(), revision).alias("revision"), F.octet_length("document").alias("size"))


def branch_context(events: DataFrame, selected: DataFrame, limit: int) -> DataFrame:
    """The events before a session's selected input that a branch from it starts with (session_id, sequence, id, source, kind, call_id, text; selected: session_id, source, at).

    Of the same source; results only where their call is before them; counted back from
    the input, as many as fit ``limit`` characters.
    """
    e = events.join(selected, ["session_id", "source"]).where("sequence < at")
    calls = F.min(F.when(F.col("kind") == "call", F.col("sequence"))).over(Window.partitionBy("session_id", "call_id"))
    e = e.withColumn("called", calls).where("kind != 'result' OR coalesce(called < sequence, false)")
    w = Window.partitionBy("session_id").orderBy(F.desc("sequence"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("size", F.sum(F.length("text")).over(w)).where(F.col("size") <= limit).select("session_id", "sequence", "id", "kind", "size")


def surrogates(rows: DataFrame, key: str, first: list[Column], prefix: str, out: str) -> DataFrame:
    """key and its surrogate id: the prefix and seven digits, in order of first use."""
    used = rows.groupBy(key).agg(F.min(F.struct(*first)).alias("first"))
    return row_numbers(used, [F.col("first"), F.col(key)], "place").select(key, F.concat(F.lit(prefix), F.lpad(F.col("place").cast("string"), 7, "0")).alias(out))


def pseudonyms(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """A replacement of each (group_id, category, quote) in order of first use (doc_id, place), that no text contains.

    Replacements are <category_group_n>. Where texts have one already, the group's
    numbers of that category begin after the largest that they have.
    """
    first = quotes.groupBy("group_id", "category", "quote").agg(F.min(F.struct("doc_id", "place")).alias("first"))
    number = F.row_number().over(Window.partitionBy("group_id").orderBy("first", "category", "quote"))
    shape = r"<([a-z]+)_([^<>_]+)_(\d+)>"
    found = texts.where(F.col("text").rlike(shape)).select(F.explode(F.regexp_extract_all("text", F.lit(shape), F.lit(0))).alias("x"))
    part = lambda n: F.regexp_extract("x", shape, n)
    taken = found.select(part(1).alias("category"), part(2).alias("group_id"), part(3).cast("long").alias("n")).groupBy("category", "group_id").agg(F.max("n").alias("taken"))
    j = first.withColumn("n", number).join(taken, ["category", "group_id"], "left")
    return j.select("group_id", "category", "quote", F.concat(F.lit("<"), "category", F.lit("_"), "group_id", F.lit("_"), (F.col("n") + F.coalesce("taken", F.lit(0))).cast("string"), F.lit(">")).alias("replacement"))


def predicted(rows: DataFrame, classes: list[str]) -> DataFrame:
    """Add label, probability and error to rows with ``probabilities``: as many as classes, none negative, adding up to one within 1e-5; ties go to the first class."""
    p = F.col("probabilities")
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    error = (
        F.when(p.isNull() | (F.size(p) != len(classes)), "wrong number of classes").when(F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0)), "not a probability")
        .when(F.abs(total - 1) > 1e-5, "not adding up to one")
    )
    best = F.array_position(p, F.array_max(p)).cast("int")
    sound = error.isNull()
    return rows.withColumns({"error": error, "label": F.when(sound, F.element_at(F.array(*map(F.lit, classes)), F.greatest(best, F.lit(1)))), "probability": F.when(sound, F.array_max(p))})


def canonical_digest(entries: Column) -> Column:
    """SHA-256 of a map of texts as JSON with sorted keys and a line end."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(entries)))
    return F.sha2(F.concat(F.to_json(ordered), F.lit("\n")), 256)


def input_origin(role: str, text: str, metadata: str) -> Column:
    """context, internal_session, notification or human: context wins over a session that another one started, that over a notification's shape.

    A session is another's if its metadata's ``source`` is ``internal`` or an object that has ``subagent``.
    """
    v = F.try_parse_json(metadata)
    source = F.try_variant_get(v, "$.source", "string")
    internal = F.coalesce((source == "internal") | F.try_variant_get(v, "$.source.subagent", "string").isNotNull(), F.lit(False))
    shape = F.trim(text).rlike(r"(?s)^<([a-z_]+)>.*</\1>$")
    return F.when(F.col(role).isin("system", "developer"), "context").when(internal, "internal_session").when(shape, "notification").otherwise("human")
