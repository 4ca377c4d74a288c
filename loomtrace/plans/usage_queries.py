"""Queries over the usage ledger."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtrace.operators import usage
from loomtrace.sources.storage import table
from loomtrace.sources.views import RATES_SQL, USAGE_LEDGER, rates, usage_ledger

W = "WITH " + USAGE_LEDGER
PRICED = f"""WITH {USAGE_LEDGER}, {RATES_SQL}, joined AS (
  SELECT u.*, r.* EXCLUDE (model), coalesce(input_tokens > long_over, false) AS long_context,
    CASE WHEN input_rate IS NULL THEN 'no rate' WHEN cached_tokens IS NULL THEN 'unknown cached tokens' WHEN input_tokens - cached_tokens < 0 THEN 'more cached than input'
         WHEN cached_rate IS NULL AND cached_tokens > 0 THEN 'no cached rate' END AS reason FROM usage_ledger u LEFT JOIN rates r USING (model)),
parts AS (SELECT *, CASE WHEN long_context THEN long_input ELSE 1.00::DECIMAL(4,2) END AS up_in, CASE WHEN long_context THEN long_output ELSE 1.00::DECIMAL(4,2) END AS up_out FROM joined),
priced AS (SELECT session_id, line_number, model, input_tokens, cached_tokens, output_tokens, used_on, reason, long_context, CASE WHEN reason IS NULL THEN
    ((input_tokens - cached_tokens)::DECIMAL(12,0) * input_rate * up_in * 0.000001::DECIMAL(6,6))::DECIMAL(28,14) + (output_tokens::DECIMAL(12,0) * output_rate * up_out * 0.000001::DECIMAL(6,6))::DECIMAL(28,14)
    + CASE WHEN cached_tokens > 0 THEN (cached_tokens::DECIMAL(12,0) * cached_rate * up_in * 0.000001::DECIMAL(6,6))::DECIMAL(28,14) ELSE 0::DECIMAL(28,14) END END AS cost FROM parts)"""


def _priced(spark, sf_dir):
    return usage.priced(usage_ledger(spark, sf_dir).drop("part"), rates(spark))


def _money(c):
    """A cost as an exact string of 14 decimals."""
    return F.col(c).cast("decimal(38,14)").cast("string")


def _with_counter(spark, sf_dir):
    """A counter of input tokens that starts anew at every fourth line and repeats its value at every third."""
    rows = usage_ledger(spark, sf_dir)
    run = F.floor((F.col("line_number") - 1) / 4)
    w = Window.partitionBy("session_id", run).orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("session_id", "line_number", F.sum(F.when(F.col("line_number") % 3 == 0, 0).otherwise(F.col("input_tokens"))).over(w).alias("counter"))


def _money_sum():
    return F.sum("cost").cast("decimal(38,14)").cast("string").alias("cost")


def usage_counter_delta(spark, sf_dir):
    return usage.counter_deltas(_with_counter(spark, sf_dir), "counter")


def usage_dedupe_first(spark, sf_dir):
    rows = usage_ledger(spark, sf_dir).withColumn("response_id", F.pmod("part", F.lit(3)))
    return usage.first_wins(rows, ["session_id", "response_id"], ["model", "input_tokens"])


def usage_priced(spark, sf_dir):
    return _priced(spark, sf_dir).select("session_id", "line_number", "model", "reason", "long_context", _money("cost").alias("cost"))


def usage_running_totals(spark, sf_dir):
    return usage.running(_priced(spark, sf_dir)).select("session_id", "line_number", "running_input", "running_output", _money("running_cost").alias("running_cost"))


def usage_by_model(spark, sf_dir):
    return usage.rollup(_priced(spark, sf_dir), ["model"]).withColumn("cost", _money("cost"))


def coverage_state(spark, sf_dir):
    return usage.rollup(_priced(spark, sf_dir), ["session_id"]).select("session_id", "coverage", "priced", "unpriced")


def null_poison_totals(spark, sf_dir):
    """Totals that are unknown where one row is; share of cached input, null without input."""
    t = usage_ledger(spark, sf_dir).groupBy("session_id").agg(usage.known_sum("cached_tokens").alias("cached_tokens"), F.sum("input_tokens").alias("input_tokens"))
    return t.withColumns({"uncached": F.col("input_tokens") - F.col("cached_tokens"), "cached_pct": F.round(F.when(F.col("input_tokens") > 0, F.col("cached_tokens") * 100.0 / F.col("input_tokens")), 6)})


def dashboard_grouping_sets(spark, sf_dir):
    """The same measures by model, by month and in total, from one scan."""
    rows = _priced(spark, sf_dir).withColumn("month", F.date_format("used_on", "yyyy-MM"))
    sets = rows.groupingSets([["model"], ["month"], []], "model", "month")
    return sets.agg(F.grouping_id().cast("long").alias("grain"), F.count("*").alias("records"), F.sum("input_tokens").alias("input_tokens"), F.count("cost").alias("priced"), _money_sum())


def dashboard_daily(spark, sf_dir):
    """A half-open window of days, filtered after pricing."""
    rows = _priced(spark, sf_dir).where("used_on >= DATE'1995-01-01' AND used_on < DATE'1996-01-01'")
    return usage.rollup(rows, ["used_on"]).select(F.col("used_on").cast("string").alias("day"), "records", "input_tokens", "priced", _money("cost").alias("cost"))


def long_context_sessions(spark, sf_dir):
    """Session and model pairs with a request over the model's threshold."""
    rows = usage_ledger(spark, sf_dir).groupBy("session_id", "model").agg(F.max("input_tokens").alias("most"))
    return rows.join(F.broadcast(rates(spark)), "model").where("most > long_over").select("session_id", "model", "most")


def asof_checkpoint_mismatch(spark, sf_dir):
    """Checkpoints at every third line say the line's total, off by one where the line is the sixth."""
    rows = usage_ledger(spark, sf_dir)
    w = Window.partitionBy("session_id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    said = rows.withColumn("total", F.sum("input_tokens").over(w) + F.when(F.col("line_number") == 6, 1).otherwise(0)).where("line_number % 3 = 0")
    return usage.checkpoint_mismatches(rows, said.select("session_id", "line_number", "total"))


def context_carry_last(spark, sf_dir):
    """The model in force at each line; only odd lines set one, and every fifth sets none."""
    rows = usage_ledger(spark, sf_dir).withColumn("named", F.when(F.col("line_number") % 5 != 0, F.col("model")))
    return usage.carried(rows, "named", F.col("line_number") % 2 == 1).select("session_id", "line_number", F.col("carried").alias("model"))


def latest_archive(spark, sf_dir):
    """Each customer's latest order and its lines' total: top one by window, then a join."""
    orders = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))
    last = orders.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("o_custkey", "o_orderkey")
    lines = usage_ledger(spark, sf_dir)
    return last.join(lines, F.col("o_orderkey") == F.col("session_id")).groupBy("o_custkey", "o_orderkey").agg(F.count("*").alias("lines"), F.sum("input_tokens").alias("input_tokens"))


def facets(spark, sf_dir):
    """Distinct values of three fields, sorted."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.explode(F.create_map(F.lit("agent"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus"), F.lit("year"), F.year("o_orderdate").cast("string"))).alias("facet", "value"))
    return rows.groupBy("facet").agg(F.array_join(F.array_sort(F.collect_set("value")), "|").alias("choices"), F.count_distinct("value").alias("n"))


QUERIES = {f.__name__: f for f in (usage_counter_delta, usage_dedupe_first, usage_priced, usage_running_totals, usage_by_model, coverage_state, null_poison_totals, dashboard_grouping_sets, dashboard_daily, long_context_sessions, asof_checkpoint_mismatch, context_carry_last, latest_archive, facets)}

_ROLL = "count(*) AS records, sum(input_tokens)::BIGINT AS input_tokens, CASE WHEN count(*) = count(cached_tokens) THEN sum(cached_tokens)::BIGINT END AS cached_tokens, sum(output_tokens)::BIGINT AS output_tokens, count(cost) AS priced, count(*) - count(cost) AS unpriced, sum(cost)::DECIMAL(38,14)::VARCHAR AS cost, CASE WHEN count(cost) = count(*) THEN 'recorded' WHEN count(cost) > 0 THEN 'partial' ELSE 'unavailable' END AS coverage"

SQL = {
    "usage_counter_delta": f"""{W}, c AS (SELECT session_id, line_number, sum(CASE WHEN line_number % 3 = 0 THEN 0 ELSE input_tokens END) OVER (PARTITION BY session_id, floor((line_number - 1) / 4) ORDER BY line_number)::BIGINT AS counter FROM usage_ledger),
p AS (SELECT *, lag(counter) OVER (PARTITION BY session_id ORDER BY line_number) AS prior FROM c), s AS (SELECT * FROM p WHERE prior IS NULL OR counter <> prior),
d AS (SELECT *, lag(counter) OVER (PARTITION BY session_id ORDER BY line_number) AS base FROM s)
SELECT * FROM (SELECT session_id, line_number, counter, CASE WHEN base IS NULL THEN counter WHEN counter >= base THEN counter - base END AS delta, coalesce(counter < base, false) AS reset FROM d) WHERE reset OR delta > 0""",
    "usage_dedupe_first": f"""{W}, r AS (SELECT *, part % 3 AS response_id FROM usage_ledger), f AS (SELECT *, first_value(model) OVER w AS m, first_value(input_tokens) OVER w AS t, min(line_number) OVER (PARTITION BY session_id, response_id) AS l FROM r WINDOW w AS (PARTITION BY session_id, response_id ORDER BY line_number))
SELECT session_id, response_id, min(l) AS line_number, any_value(m) AS model, any_value(t) AS input_tokens, count(*) FILTER (line_number > l AND model = m AND input_tokens = t) AS identical, count(*) FILTER (line_number > l AND NOT (model = m AND input_tokens = t)) AS conflicting FROM f GROUP BY session_id, response_id""",
    "usage_priced": f"{PRICED} SELECT session_id, line_number, model, reason, long_context, cost::DECIMAL(38,14)::VARCHAR AS cost FROM priced",
    "usage_running_totals": f"{PRICED} SELECT session_id, line_number, (sum(input_tokens) OVER w)::BIGINT AS running_input, (sum(output_tokens) OVER w)::BIGINT AS running_output, (sum(cost) OVER w)::DECIMAL(38,14)::VARCHAR AS running_cost FROM priced WINDOW w AS (PARTITION BY session_id ORDER BY line_number)",
    "usage_by_model": f"{PRICED} SELECT model, {_ROLL} FROM priced GROUP BY model",
    "coverage_state": f"{PRICED} SELECT session_id, coverage, priced, unpriced FROM (SELECT session_id, {_ROLL} FROM priced GROUP BY session_id)",
    "null_poison_totals": f"{W}, t AS (SELECT session_id, CASE WHEN count(*) = count(cached_tokens) THEN sum(cached_tokens)::BIGINT END AS cached_tokens, sum(input_tokens)::BIGINT AS input_tokens FROM usage_ledger GROUP BY session_id) SELECT *, input_tokens - cached_tokens AS uncached, round(CASE WHEN input_tokens > 0 THEN cached_tokens * 100.0::DOUBLE / input_tokens END, 6) AS cached_pct FROM t",
    "dashboard_grouping_sets": f"{PRICED} SELECT model, month, grouping(model, month)::BIGINT AS grain, count(*) AS records, sum(input_tokens)::BIGINT AS input_tokens, count(cost) AS priced, sum(cost)::DECIMAL(38,14)::VARCHAR AS cost FROM (SELECT *, strftime(used_on, '%Y-%m') AS month FROM priced) GROUP BY GROUPING SETS ((model), (month), ())",
    "dashboard_daily": f"{PRICED} SELECT used_on::VARCHAR AS day, count(*) AS records, sum(input_tokens)::BIGINT AS input_tokens, count(cost) AS priced, sum(cost)::DECIMAL(38,14)::VARCHAR AS cost FROM priced WHERE used_on >= DATE '1995-01-01' AND used_on < DATE '1996-01-01' GROUP BY used_on",
    "long_context_sessions": f"{W}, {RATES_SQL} SELECT session_id, model, max(input_tokens) AS most FROM usage_ledger JOIN rates USING (model) GROUP BY session_id, model, long_over HAVING max(input_tokens) > long_over",
    "asof_checkpoint_mismatch": f"{W}, r AS (SELECT *, (sum(input_tokens) OVER (PARTITION BY session_id ORDER BY line_number))::BIGINT AS running FROM usage_ledger) SELECT session_id, line_number, running + 1 AS total, running FROM r WHERE line_number = 6",
    "context_carry_last": f"{W} SELECT session_id, line_number, CASE WHEN odd % 5 <> 0 THEN (SELECT model FROM usage_ledger b WHERE b.session_id = a.session_id AND b.line_number = a.odd) END AS model FROM (SELECT session_id, line_number, max(CASE WHEN line_number % 2 = 1 THEN line_number END) OVER (PARTITION BY session_id ORDER BY line_number) AS odd FROM usage_ledger) a",
    "latest_archive": f"{W}, l AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) SELECT o_custkey, o_orderkey, count(*) AS lines, sum(input_tokens)::BIGINT AS input_tokens FROM l JOIN usage_ledger ON session_id = o_orderkey GROUP BY ALL",
    "facets": "WITH v AS (SELECT 'agent' AS facet, o_orderpriority AS value FROM orders UNION ALL SELECT 'status', o_orderstatus FROM orders UNION ALL SELECT 'year', year(o_orderdate)::VARCHAR FROM orders) SELECT facet, array_to_string(list_sort(list(DISTINCT value)), '|') AS choices, count(DISTINCT value) AS n FROM v GROUP BY facet",
}
