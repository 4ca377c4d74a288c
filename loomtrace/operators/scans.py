"""Results of scans of chunks: validated field by field, moved to their messages, merged, or refused whole.

A result is JSON text about one chunk: its id, whether it asks for a review, and
findings with bounds, the quote between them and a category. Nothing may be missing,
more, or of another type. Sound findings move by where their chunk begins in the
message. Chunks overlap, so a finding may come twice, or as the part of it that its
chunk still has: one that lies in another of its category, with the same letters, goes.
Any other overlap, one refused result, or a chunk without a result refuses the message.

Cases: equal results of a chunk count once, several different ones refuse it. A null
or broken body isn't an object. A message's findings are one window, as many as scans
found in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a result and a finding have, and why one is refused (in the order of the rules).
RESULT, FINDING = ("chunk_id", "findings", "requires_review"), ("category", "end", "quote", "start")
REASONS = ("unexpected result fields", "another chunk or no review flag", "findings are no list", "unexpected finding fields", "bounds outside the chunk", "quote differs from the chunk", "unknown category")


def _fields(v: Column, names: tuple[str, ...]) -> Column:
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    return F.coalesce(F.array_sort(keys) == F.array(*map(F.lit, names)), F.lit(False))


def _is(v: Column, path: str, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == kind, F.lit(False))


def validated(results: DataFrame, chunks: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """message, chunk_id, reason (null: sound), review, findings (start, end, quote, category in the message) of each chunk with a result.

    results: chunk_id, body; chunks: message, chunk_id, start, text.
    """
    j = chunks.join(results.select("chunk_id", "body").distinct(), "chunk_id").withColumn("v", F.try_parse_json("body"))
    item = lambda path, kind: F.try_variant_get("x", path, kind)
    list_ = F.try_variant_get("v", "$.findings", "array<variant>")
    head = (
        F.when(~_fields(F.col("v"), RESULT), 0).when(~F.coalesce(F.try_variant_get("v", "$.chunk_id", "string") == F.col("chunk_id"), F.lit(False)) | ~_is(F.col("v"), "$.requires_review", "BOOLEAN"), 1)
        .when(list_.isNull(), 2)
    )
    j = j.select("message", "chunk_id", "body", "start", "text", head.alias("head"), F.try_variant_get("v", "$.requires_review", "boolean").alias("review"), F.explode_outer(list_).alias("x"))
    whole = lambda path: _is(F.col("x"), path, "BIGINT")
    a, b = item("$.start", "long"), item("$.end", "long")
    within = whole("$.start") & whole("$.end") & F.coalesce((a >= 0) & (a < b) & (b <= F.length("text")), F.lit(False))
    same = _is(F.col("x"), "$.quote", "STRING") & F.coalesce(item("$.quote", "string") == F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")), F.lit(False))
    known = _is(F.col("x"), "$.category", "STRING") & F.coalesce(item("$.category", "string").isin(*categories), F.lit(False))
    reason = F.when(F.col("head").isNotNull(), F.col("head")).when(F.col("x").isNotNull(), F.when(~_fields(F.col("x"), FINDING), 3).when(~within, 4).when(~same, 5).when(~known, 6))
    found = F.when(reason.isNull() & F.col("x").isNotNull(), F.struct((a + F.col("start")).alias("start"), (b + F.col("start")).alias("end"), item("$.quote", "string").alias("quote"), item("$.category", "string").alias("category")))
    rows = j.select("message", "chunk_id", "body", "review", reason.alias("reason"), found.alias("found"))
    # the first finding that breaks a rule says which
    by = rows.groupBy("message", "chunk_id", "body").agg(F.min("reason").alias("reason"), F.max("review").alias("review"), F.collect_set("found").alias("findings"))
    by = by.groupBy("message", "chunk_id").agg(F.count("*").alias("n"), F.min("reason").alias("reason"), F.max("review").alias("review"), F.flatten(F.collect_list("findings")).alias("findings"))
    text = F.element_at(F.array(*map(F.lit, REASONS)), F.col("reason") + 1)
    why = F.when(F.col("n") > 1, "several results").when(F.col("reason").isNotNull(), text)
    return by.select("message", "chunk_id", why.alias("reason"), "review", F.when(why.isNull(), F.col("findings")).alias("findings"))


def merged(checked: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages (message, state, reason, review) and the findings of accepted ones (message, start, end, quote, category)."""
    rows = checked.select("message", "chunk_id", F.explode("findings").alias("f")).select("message", "chunk_id", "f.*")
    one = Window.partitionBy("message", "chunk_id").orderBy("start", F.desc("end"), "category").rowsBetween(Window.unboundedPreceding, -1)
    # in a chunk no two findings meet
    inside = rows.withColumn("met", F.col("start") < F.max("end").over(one)).where("met").select("message").distinct()
    w = Window.partitionBy("message").orderBy("start", F.desc("end"), "category").rowsBetween(Window.unboundedPreceding, -1)
    holder = F.max(F.struct("end", (-F.col("start")).alias("back"), "category", "quote")).over(w)
    each = rows.select("message", "start", "end", "quote", "category").distinct().withColumn("h", holder)
    meets = F.coalesce(F.col("start") < F.col("h.end"), F.lit(False))
    offset = F.col("start") + F.col("h.back")
    part = (F.col("end") <= F.col("h.end")) & (F.col("category") == F.col("h.category")) & (F.col("quote") == F.substring(F.col("h.quote"), (offset + 1).cast("int"), F.length("quote")))
    each = each.withColumn("state", F.when(~meets, "kept").when(part, "contained").otherwise("conflict"))
    clash = each.where("state = 'conflict'").select("message").unionByName(inside).distinct().withColumn("clash", F.lit(True))
    wanted = chunks.groupBy("message").agg(F.count_distinct("chunk_id").alias("wanted"))
    had = checked.groupBy("message").agg(F.count("*").alias("had"), F.min("reason").alias("reason"), F.max("review").alias("review"))
    j = wanted.join(had, "message", "left").join(clash, "message", "left")
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.coalesce("had", F.lit(0)) < F.col("wanted"), "a chunk has no result").when(F.col("clash"), "findings conflict")
    messages = j.select("message", F.when(reason.isNull(), "accepted").otherwise("refused").alias("state"), reason.alias("reason"), F.coalesce("review", F.lit(False)).alias("review"))
    kept = each.where("state = 'kept'").join(messages.where("state = 'accepted'").select("message"), "message", "left_semi")
    return messages, kept.select("message", "start", "end", "quote", "category")
