"""Usage of whole sessions from their records: response records, or deltas of cumulative counters where there are none.

Counts are a struct of six fields (``FIELDS``), of which all but input and output may
be unknown. Whatever a reader would remember is a window by line over one shuffle by
session; nothing is carried in code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
COUNTS = "struct<" + ",".join(f"{f}:bigint" for f in FIELDS) + ">"
#: Findings that make a session's coverage partial, and those of counters that don't count where responses were recorded (fixed values).
PARTIAL = ("invalid_usage_records", "missing_response_ids", "conflicting_response_records", "invalid_cumulative_records", "cumulative_resets", "invalid_cumulative_deltas", "tokens_outside_response_records", "usage_summary_mismatches")
COUNTER_ONLY = ("invalid_cumulative_records", "cumulative_resets", "invalid_cumulative_deltas")
RESPONSES, DELTAS = "response_usage", "cumulative_delta"


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def counted(u: str) -> Column:
    """The counts with their total, or null: input or output unknown, a negative count, more cached and written than input, more reasoning than output, or another total."""
    f = {name: F.col(f"{u}.{name}") for name in FIELDS}
    total = f["input_tokens"] + f["output_tokens"]
    zero = lambda c: F.coalesce(c, F.lit(0))
    sound = _all([f["input_tokens"].isNotNull(), f["output_tokens"].isNotNull(), *(zero(c) >= 0 for c in f.values())])
    sound = sound & (zero(f["cached_input_tokens"]) + zero(f["cache_write_input_tokens"]) <= f["input_tokens"]) & (zero(f["reasoning_output_tokens"]) <= f["output_tokens"])
    sound = sound & F.coalesce(f["total_tokens"] == total, F.lit(True))
    return F.when(sound, F.struct(*[f[n].alias(n) for n in FIELDS[:-1]], total.alias("total_tokens")))


def response_rows(records: DataFrame) -> DataFrame:
    """Add tokens and finding to response records (session_id, line_number, response_id, usage); the first of each id by line has no finding."""
    rows = records.withColumn("tokens", counted("usage"))
    named = F.coalesce(F.col("response_id"), F.lit("")) != ""
    rows = rows.withColumn("usable", F.col("tokens").isNotNull() & named)
    first = F.first("tokens").over(Window.partitionBy("session_id", "response_id", "usable").orderBy("line_number"))
    earlier = F.row_number().over(Window.partitionBy("session_id", "response_id", "usable").orderBy("line_number")) > 1
    rows = rows.withColumns({"first": first, "again": earlier})
    finding = (
        F.when(F.col("tokens").isNull(), "invalid_usage_records").when(~named, "missing_response_ids")
        .when(F.col("again") & F.col("tokens").eqNullSafe(F.col("first")), "duplicate_response_records").when(F.col("again"), "conflicting_response_records")
    )
    return rows.withColumn("finding", finding).drop("usable", "first", "again")


def counter_rows(records: DataFrame) -> DataFrame:
    """Add tokens (what the counter adds), request_known, said (the model before it is doubted) and finding to counter records (session_id, line_number, model, usage, last).

    A reading equal to the one before is a repeat. A fall in any field known on both
    sides is a reset: no row, but the next one's base. A field unknown on either side is
    unknown in the delta. A row of no tokens has finding ``nothing_added``.
    """
    rows = records.withColumns({"reading": counted("usage"), "last": counted("last")})
    rows = rows.withColumn("sound", F.col("reading").isNotNull())
    # the last reading of that kind, not a window by kind: all windows share one sort
    before = Window.partitionBy("session_id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("prior", F.last("reading", ignorenulls=True).over(before))
    rows = rows.withColumn("live", F.col("sound") & ~F.col("reading").eqNullSafe(F.col("prior")))
    rows = rows.withColumn("base", F.last(F.when(F.col("live"), F.col("reading")), ignorenulls=True).over(before))
    of = lambda name: (F.col(f"reading.{name}"), F.col(f"base.{name}"))
    reset = F.col("base").isNotNull() & _any([F.coalesce(a < b, F.lit(False)) for a, b in map(of, FIELDS)])
    added = F.struct(*[F.when(F.col("base").isNull(), a).otherwise(a - b).alias(n) for n, (a, b) in zip(FIELDS, map(of, FIELDS))])
    rows = rows.withColumns({"reset": reset, "added": added}).withColumn("tokens", F.when(F.col("live") & ~F.col("reset"), counted("added")))
    finding = (
        F.when(~F.col("sound"), "invalid_cumulative_records").when(~F.col("live"), "duplicate_cumulative_records").when(F.col("reset"), "cumulative_resets")
        .when(F.col("tokens").isNull(), "invalid_cumulative_deltas").when(F.col("tokens.total_tokens") == 0, "nothing_added")
    )
    known = F.coalesce((F.col("tokens.input_tokens") == F.col("last.input_tokens")) & (F.col("tokens.output_tokens") == F.col("last.output_tokens")), F.lit(False))
    rows = rows.withColumns({"finding": finding, "request_known": known, "said": F.col("model")})
    return rows.withColumn("model", F.when(F.col("request_known"), F.col("model"))).drop("sound", "prior", "live", "base", "reset", "added", "reading")


def priced_requests(rows: DataFrame, card: DataFrame, named: str = "model", context: str | None = None) -> DataFrame:
    """Add reason, long_context and cost to requests (session_id, line_number, model, tokens, request_known).

    card: model, input, cached, write, output (prices of a million tokens), scope
    (request, session or null), threshold, input_factor, output_factor; a small
    dimension, sent to all tasks. named: a column of the model that a row names even where
    ``model`` is doubted; context: one of how long its context with that model was.

    A model whose scope is the session is long in all of it once one request was; where
    requests of unknown size may have been that one, its rows have no price.
    """
    size = F.when(F.col("request_known"), F.col("tokens.input_tokens"))
    longest = F.max(F.greatest(size, F.col(context)) if context else size).over(Window.partitionBy("session_id", named))
    unknown = F.max(F.when(~F.col("request_known"), F.col("tokens.input_tokens"))).over(Window.partitionBy("session_id"))
    j = rows.withColumn("unknown", unknown).withColumn("longest", longest).withColumn("longest", F.when(F.col("model").isNotNull(), F.col("longest")))
    j = j.join(F.broadcast(card), "model", "left")
    session = F.coalesce((F.col("scope") == "session"), F.lit(False))
    over = lambda c: F.coalesce(session & (F.col(c) > F.col("threshold")), F.lit(False))
    cached, writes = F.col("tokens.cached_input_tokens"), F.col("tokens.cache_write_input_tokens")
    reason = (
        F.when(over("unknown") & ~over("longest"), "session context tier unavailable")
        .when(F.col("input").isNull(), "unknown model")
        .when(F.col("scope").isNotNull() & ~F.col("request_known"), "context size unavailable")
        .when(cached.isNull() & F.col("cached").isNotNull(), "cached count unavailable")
        .when(writes.isNull() & F.col("write").isNotNull(), "cache-write count unavailable")
        .when((F.coalesce(cached, F.lit(0)) > 0) & F.col("cached").isNull(), "cached rate unavailable")
    )
    long = F.col("scope").isNotNull() & (F.coalesce(F.col("tokens.input_tokens") > F.col("threshold"), F.lit(False)) | over("longest"))
    one = F.lit("1.00").cast("decimal(4,2)")
    zero = lambda c: F.coalesce(c, F.lit(0))
    up_in, up_out = F.when(long, F.col("input_factor")).otherwise(one), F.when(long, F.col("output_factor")).otherwise(one)
    part = lambda n, rate, up: (n.cast("decimal(12,0)") * rate * up * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(28,14)")
    plain = F.col("tokens.input_tokens") - zero(cached) - zero(writes)
    cost = part(plain, F.col("input"), up_in) + part(zero(cached), F.coalesce("cached", "input"), up_in) + part(zero(writes), F.coalesce("write", "input"), up_in) + part(F.col("tokens.output_tokens"), F.col("output"), up_out)
    out = j.withColumns({"reason": reason, "long_context": F.coalesce(long, F.lit(False))})
    out = out.withColumn("cost", F.when(F.col("reason").isNull(), cost.cast("decimal(28,14)")))
    return out.drop("input", "cached", "write", "output", "scope", "threshold", "input_factor", "output_factor", "unknown", "longest")


def totals(window) -> Column:
    """Running sums of the fields of rows (``counts``), each unknown from its first unknown value on, and 0 before any row: one struct."""
    row = F.col("counts")
    n = F.count_if(row).over(window)
    return F.struct(*[F.when(n == F.count_if(row & F.col(f"tokens.{f}").isNotNull()).over(window), F.coalesce(F.sum(F.when(row, F.col(f"tokens.{f}"))).over(window), F.lit(0))).alias(f) for f in FIELDS])


def compared(entries: DataFrame, said: Column, order: tuple[str, ...] = ("line_number",)) -> DataFrame:
    """Add ``said`` and ``wrong`` (neither running total up to an entry agrees with what it says) to entries (session_id, line_number, turn_id, counts, tokens, scope).

    An entry may be a row that counts, say something of the totals up to and with it, or both.
    """
    frame = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # turns first: what is said may be a window by thread, and shares the sort of the thread's totals
    got = entries.withColumn("turn", totals(frame("session_id", "turn_id"))).withColumns({"said": said, "thread": totals(frame("session_id"))})
    agrees = lambda name: _all([F.coalesce(F.col(f"{name}.{f}") == F.col(f"said.{f}"), F.lit(True)) for f in FIELDS])
    by_thread = F.col("scope").isin("thread", "thread_or_turn")
    by_turn = F.col("scope").isin("turn", "thread_or_turn") & F.col("turn_id").isNotNull()
    wrong = F.col("said").isNotNull() & (by_thread | by_turn) & ~((by_thread & agrees("thread")) | (by_turn & agrees("turn")))
    return got.withColumn("wrong", F.coalesce(wrong, F.lit(False))).drop("turn", "thread")


def summary_mismatches(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """Summaries (session_id, line_number, turn_id, scope, tokens) that no running total of rows (session_id, line_number, turn_id, tokens) up to their line agrees with.

    Scopes: thread, turn, or thread_or_turn, which either total may satisfy. Unknown
    fields agree with anything.
    """
    nothing = F.lit(None).cast(COUNTS)
    both = rows.select("session_id", "line_number", "turn_id", F.lit(0).alias("kind"), F.lit(True).alias("counts"), F.lit(None).cast("string").alias("scope"), "tokens", nothing.alias("summary"))
    both = both.unionByName(summaries.select("session_id", "line_number", "turn_id", F.lit(1).alias("kind"), F.lit(False).alias("counts"), "scope", nothing.alias("tokens"), F.col("tokens").alias("summary")))
    return compared(both, F.col("summary"), ("line_number", "kind")).where("wrong").select("session_id", "line_number", "scope", "turn_id")


def accounted(marks: DataFrame, *of_session: str) -> DataFrame:
    """session_id, records, total_tokens (null without records) and findings (an array of finding and n) of marked entries (session_id, finding, own, total, wrong).

    own: tokens of an entry that is counted; total: what it says of all of them. Findings
    are counts of what is positive: of each name, summaries that don't agree, and tokens
    that totals have beyond those counted. Sessions in one partition stay there.
    of_session: columns that are one in each session, and stay.
    """
    sums = [F.count("own").alias("records"), F.sum("own").alias("own"), F.max("total").alias("total"), F.count_if("wrong").alias("wrong")]
    by = marks.groupBy("session_id", *of_session, "finding").agg(F.count("*").alias("n"), *sums)
    each = F.collect_list(F.when(F.col("finding").isNotNull(), F.struct("finding", "n")))  # as many as there are names
    by = by.groupBy("session_id", *of_session).agg(each.alias("each"), F.sum("records").alias("records"), F.sum("own").alias("own"), F.max("total").alias("total"), F.sum("wrong").alias("wrong"))
    named = lambda name, n: F.array(F.struct(F.lit(name).alias("finding"), n.alias("n")))
    found = F.concat("each", named("tokens_outside_response_records", F.col("total") - F.coalesce("own", F.lit(0))), named("usage_summary_mismatches", F.col("wrong")))
    return by.select("session_id", *of_session, "records", F.col("own").alias("total_tokens"), F.filter(found, lambda x: x["n"] > 0).alias("findings"))


def listed(accounts: DataFrame) -> DataFrame:
    """session_id, finding, n of accounts."""
    return accounts.select("session_id", F.inline("findings"))


_ENTRY = ("session_id", "line_number", "turn_id", "model", "source", "request_known", "tokens", "finding", "scope", "summary")


def response_entries(records: DataFrame, scope: Column | None = None, said: Column | None = None) -> DataFrame:
    """Entries of response records; scope and said: what each says besides of its thread's or turn's total."""
    none = F.lit(None)
    rows = response_rows(records).withColumns({"source": F.lit("response"), "request_known": F.lit(True)})
    return rows.withColumns({"scope": none.cast("string") if scope is None else scope, "summary": none.cast(COUNTS) if said is None else said}).select(*_ENTRY)


def counter_entries(records: DataFrame, silent: Column | None = None) -> DataFrame:
    """Entries of counter records, of which ``silent`` ones are notifications without counts. Readings are summaries too."""
    silent = F.lit(False) if silent is None else F.coalesce(silent, F.lit(False))
    rows = records.withColumn("silent", silent).withColumn("usage", F.when(~F.col("silent"), F.col("usage")))
    rows = counter_rows(rows).withColumns({"source": F.lit("counter"), "scope": F.lit("thread_or_turn"), "summary": counted("usage")})
    return rows.withColumn("finding", F.when(F.col("silent"), "empty_token_notifications").otherwise(F.col("finding"))).select(*_ENTRY)


def _entries(df: DataFrame, **columns: Column) -> DataFrame:
    """Entries of one more kind: nulls where nothing is given."""
    kinds = {"line_number": "long", "request_known": "boolean", "tokens": COUNTS, "summary": COUNTS}
    return df.select("session_id", *[columns.get(c, F.lit(None).cast(kinds.get(c, "string"))).alias(c) for c in _ENTRY[1:]])


def session_accounts(responses: DataFrame, counters: DataFrame, empty: DataFrame, summaries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, findings and reports of sessions that were recorded by responses, by counters, or both.

    responses and counters: records as ``response_rows`` and ``counter_rows`` take them;
    empty: session_id of notifications without counts; summaries: what responses say of
    their thread's and turn's totals. As ``entry_accounts``.
    """
    said = _entries(summaries, line_number=F.col("line_number"), turn_id=F.col("turn_id"), source=F.lit("summary"), scope=F.col("scope"), summary=F.col("tokens"))
    silent = _entries(empty, source=F.lit("empty"), finding=F.lit("empty_token_notifications"))
    return entry_accounts(response_entries(responses).unionByName(counter_entries(counters)).unionByName(said).unionByName(silent))


def entry_accounts(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, findings and reports of sessions from all of their entries, at one shuffle by session.

    A session with any response record is counted by those: counters are another account
    of the same usage, whose readings are summaries then, and whose faults don't count.
    Else it is counted by what its counters add.

    Rows: session_id, line_number, turn_id, model, tokens, request_known, method.
    Findings: session_id, finding, n. Reports: session_id, method, records,
    total_tokens, coverage: partial where a finding says so, unavailable without rows.
    """
    response, counter = F.col("source") == "response", F.col("source") == "counter"
    direct = F.max(response).over(Window.partitionBy("session_id"))
    e = entries.withColumn("direct", direct)
    ignored = (F.col("finding") == "nothing_added") | (counter & F.col("direct") & F.col("finding").isin(*COUNTER_ONLY))
    e = e.withColumns({
        "counted": F.col("finding").isNull() & (response | (counter & ~F.col("direct"))), "kind": F.when(response, 0).otherwise(1), "method": F.when(F.col("direct"), RESPONSES).otherwise(DELTAS),
        "finding": F.when(~F.coalesce(ignored, F.lit(False)), F.col("finding")),
    })
    rows = e.where("counted").select("session_id", "line_number", "turn_id", "model", "tokens", "request_known", "method")
    e = e.withColumn("counts", F.col("counted") & response)
    e = compared(e.select("session_id", "line_number", "turn_id", "kind", "method", "counted", "counts", "tokens", "finding", "scope", F.when(F.col("direct"), F.col("summary")).alias("summary")), F.col("summary"), ("line_number", "kind"))
    marks = e.select("session_id", "method", "finding", F.when(F.col("counted"), F.col("tokens.total_tokens")).alias("own"), F.col("said.total_tokens").alias("total"), "wrong")
    accounts = accounted(marks, "method")
    coverage = F.when(F.col("records") == 0, "unavailable").when(F.exists("findings", lambda x: x["finding"].isin(*PARTIAL)), "partial").otherwise("recorded")
    reports = accounts.select("session_id", "method", "records", F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"), coverage.alias("coverage"))
    return rows, listed(accounts), reports
