"""The trace model's tables as views over the driver's tables, and the same views as SQL.

``trace_events``: an event's interval runs ``value`` hours from its timestamp;
purchases without a whole value stay open. ``usage_ledger``: a line item is a
usage row of the session that its order is; lines are numbered anew, since the table repeats numbers. ``turns``: conversation turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtrace.sources.storage import table


def micros(ts):
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = micros("ts")
    length = F.round(F.col("value") * 3600).cast("long") * 1_000_000
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("kind"),
        F.concat(F.lit("s"), F.pmod("event_id", F.lit(3)).cast("string")).alias("source"), start.alias("start_us"),
        F.when((F.col("event_type") == "error") & (F.pmod("event_id", F.lit(4)) == 0), None).otherwise(start + length).alias("end_us"), F.col("props").alias("attributes"),
    )


TRACE_EVENTS = """trace_events AS (
  SELECT event_id AS id, user_id AS session_id, event_type AS kind, 's' || (event_id % 3)::VARCHAR AS source, epoch_us(ts) AS start_us,
         CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN NULL ELSE epoch_us(ts) + round(value * 3600)::BIGINT * 1000000 END AS end_us, props AS attributes
  FROM events)"""


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, numbered from 1 in each order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    return table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.row_number().over(order))


def usage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, line_number, model, input_tokens, cached_tokens, output_tokens, used_at (day)."""
    li = numbered_lines(spark, sf_dir)
    tokens = F.col("l_quantity").cast("long") * 100
    cached = F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 1), None).otherwise((F.round(F.col("l_discount") * 100)).cast("long") * F.col("l_quantity").cast("long"))
    return li.select(
        F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("line_number"), F.concat("l_returnflag", "l_linestatus").alias("model"), tokens.alias("input_tokens"),
        cached.alias("cached_tokens"), (F.round(F.col("l_tax") * 100).cast("long") * 10).alias("output_tokens"), F.to_date("l_shipdate").alias("used_on"), F.col("l_partkey").alias("part"),
    )


NUMBERED = "numbered AS (SELECT * REPLACE (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate)::INT AS l_linenumber) FROM lineitem)"
USAGE_LEDGER = f"""{NUMBERED},
usage_ledger AS (
  SELECT l_orderkey AS session_id, l_linenumber AS line_number, l_returnflag || l_linestatus AS model, l_quantity::BIGINT * 100 AS input_tokens,
         CASE WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN NULL ELSE round(l_discount * 100)::BIGINT * l_quantity::BIGINT END AS cached_tokens,
         round(l_tax * 100)::BIGINT * 10 AS output_tokens, l_shipdate::DATE AS used_on, l_partkey AS part
  FROM numbered)"""

#: model, input, cached, output price of a million tokens, long-context threshold, its input and output factors. RF has none: unpriced.
RATES = [("AF", "1.250000", "0.125000", "10.000000", 3000, "2.00", "1.50"), ("NF", "2.500000", None, "15.000000", None, None, None), ("NO", "0.250000", "0.025000", "2.000000", None, None, None)]


def rates(spark: SparkSession) -> DataFrame:
    """The rate card: a dimension of a few rows, fixed in the code."""
    raw = spark.createDataFrame(RATES, "model string, input string, cached string, output string, long_over long, long_input string, long_output string")
    money, factor = "decimal(12,6)", "decimal(4,2)"
    return raw.select("model", *(F.col(c).cast(money).alias(f"{c}_rate") for c in ("input", "cached", "output")), "long_over", F.col("long_input").cast(factor).alias("long_input"), F.col("long_output").cast(factor).alias("long_output"))


def _sql(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) and not x[0].isdigit() else str(x)


RATES_SQL = f"""raw_rates(model, a, b, c, long_over, d, e) AS (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in RATES)}),
rates AS (SELECT model, a::DECIMAL(12,6) AS input_rate, b::DECIMAL(12,6) AS cached_rate, c::DECIMAL(12,6) AS output_rate, long_over::BIGINT AS long_over,
  d::DECIMAL(4,2) AS long_input, e::DECIMAL(4,2) AS long_output FROM raw_rates)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("index"), "role", "text")
