"""Rollouts: session transcripts as JSON Lines, read into one row a record.

``lines_of`` numbers physical lines from 1 and keeps blank ones; ``records``
decodes them under a declared schema. A file is left out whole, by an anti join on
its bad lines, if one of its records isn't sound JSON, is no object, has a payload
that is none, or lacks a strict time. A record may lack its payload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtrace.functions.text import strict_micros
from loomtrace.operators.graph import dealt_anew
from loomtrace.sources.storage import table


PAYLOAD = "STRUCT<type: STRING, id: STRING, turn_id: STRING, model: STRING, role: STRING, phase: STRING, message: STRING, text: STRING, call_id: STRING, name: STRING, arguments: STRING, output: STRING>"
RECORD = f"STRUCT<timestamp: STRING, type: STRING, payload: {PAYLOAD}>"


def lines_of(files: DataFrame) -> DataFrame:
    """file, line_number, line of whole files (columns file, value)."""
    parts = F.split("value", "\r\n|\n|\r")
    # what follows the last line end is no line if it is empty; taken off before, as behind the generator every line would split the file again
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return files.select("file", F.posexplode(parts).alias("pos", "line")).select("file", (F.col("pos") + 1).alias("line_number"), "line")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Every ``*.jsonl`` under a path."""
    found = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path)
    return found.select(F.col("_metadata.file_path").alias("file"), "value")


def decoded(lines: DataFrame) -> DataFrame:
    """file, line_number, at_us, type, payload, sound of lines that aren't blank, and what else there is."""
    full = lines.where(F.trim("line") != "")
    # nothing may follow the record: what could close an array can't close an object, and a comma makes a second item
    in_list, in_object = F.try_parse_json(F.concat(F.lit("["), "line", F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"x":'), "line", F.lit("}")))
    parsed = full.withColumns({"list": in_list, "alone": in_object.isNotNull(), "r": F.from_json("line", RECORD, {"mode": "PERMISSIVE"})})
    has = lambda path, kind: F.try_variant_get("list", path, kind).isNotNull()
    one = F.size(F.try_variant_get("list", "$", "array<variant>")) == 1
    sound = F.col("alone") & one & has("$[0]", "map<string,variant>") & (has("$[0].payload", "map<string,variant>") | ~has("$[0].payload", "variant"))
    at = strict_micros(F.col("r.timestamp"))
    payload = F.coalesce("r.payload", F.from_json(F.lit("{}"), PAYLOAD))
    others = [c for c in lines.columns if c not in ("file", "line_number", "line")]
    return parsed.select("file", "line_number", *others, at.alias("at_us"), F.col("r.type").alias("type"), payload.alias("payload"), F.coalesce(sound & at.isNotNull(), F.lit(False)).alias("sound"))


def records(lines: DataFrame) -> DataFrame:
    """file, line_number, at_us, type, payload of the records of sound files."""
    parsed = decoded(lines.select("file", "line_number", "line"))
    bad = parsed.where("NOT sound").select("file").distinct()
    return parsed.join(dealt_anew(bad, "file"), "file", "left_anti").drop("sound")


def archived(lines: DataFrame, block: int = 1000) -> DataFrame:
    """file, line_count, byte_count, sha256 of each file of lines.

    The digest is of the digests of blocks of lines, in order, each of the digests of
    its lines; so no group holds more than a block, or a line of each block.
    """
    own = lines.select("file", F.floor((F.col("line_number") - 1) / block).alias("block"), F.struct("line_number", F.sha2("line", 256).alias("h")).alias("x"), F.octet_length("line").alias("size"))
    joined = lambda c: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["h"]), ""), 256)
    blocks = own.groupBy("file", "block").agg(joined("x").alias("h"), F.count("*").alias("n"), F.sum("size").alias("size"))
    return blocks.groupBy("file").agg(F.sum("n").alias("line_count"), (F.sum("size") + F.sum("n")).alias("byte_count"), joined(F.struct("block", "h")).alias("sha256"))


def versions(deliveries: DataFrame) -> DataFrame:
    """The archives that deliveries add (columns session_id, sha256, mapping, delivery): the first of equal ones, numbered from 1 in each session."""
    first = deliveries.groupBy("session_id", "sha256", "mapping").agg(F.min("delivery").alias("delivery"), F.count("*").alias("deliveries"))
    return first.withColumn("version", F.row_number().over(Window.partitionBy("session_id").orderBy("delivery", "mapping", "sha256")))


def derived_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations written as rollouts, one row a line: file, line_number, line.

    A conversation is a session; each of its turns starts a task that a message, a
    tool call for every second answer and its output, and a final answer make up.
    System turns are instructions; a null role is the user's.
    """
    t = table(spark, sf_dir, "conversations").withColumn("role", F.coalesce("role", F.lit("user"))).withColumn("text", F.coalesce("text", F.lit("")))
    t = t.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    base = 1_700_000_000_000_000 + F.col("conv_id") * 86_400_000_000 + F.col("n").cast("long") * 60_000_000
    stamp = lambda s: F.date_format(F.timestamp_micros(base + s * 1_000_000), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    turn = F.concat(F.lit("t"), F.ceil(F.col("n") / 2).cast("string"))
    call = F.concat(F.lit("c"), F.col("n").cast("string"))

    def record(order: int, second: int, kind: str, **payload):
        body = F.struct(*[v.alias(k) for k, v in payload.items()])
        return F.struct(F.lit(order).alias("k"), F.to_json(F.struct(stamp(second).alias("timestamp"), F.lit(kind).alias("type"), body.alias("payload"))).alias("json"))

    lit = F.lit
    system = F.array(record(0, 0, "response_item", type=lit("message"), role=lit("system"), text=F.col("text")))
    user = F.array(record(0, 0, "event_msg", type=lit("task_started"), turn_id=turn), record(1, 1, "response_item", type=lit("message"), role=lit("user"), text=F.col("text")))
    plain = F.array(record(5, 20, "response_item", type=lit("message"), role=lit("assistant"), phase=lit("final_answer"), text=F.col("text")), record(6, 21, "event_msg", type=lit("task_complete"), turn_id=turn))
    tool = F.array(record(2, 2, "response_item", type=lit("function_call"), call_id=call, name=F.when(F.col("n") % 8 == 0, "request_user_input").otherwise("shell"), arguments=lit("{}")), record(3, 9, "response_item", type=lit("function_call_output"), call_id=F.when(F.col("n") % 6 != 0, call).otherwise("lost"), output=F.when(F.col("n") % 10 == 0, "Process exited with code 2").otherwise("Wall time: 5.5 seconds")))
    made = F.when(F.col("role") == "system", system).when(F.col("role") == "user", user).when(F.col("n") % 4 < 3, F.concat(tool, plain)).otherwise(plain)
    rows = t.select("conv_id", "n", F.explode(made).alias("r"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("n", "r.k")) + 2
    body = rows.select("conv_id", place.alias("line_number"), F.col("r.json").alias("line"))
    head = F.concat(lit('{"timestamp":"2023-11-14T00:00:00Z","type":"session_meta","payload":{"id":"'), F.col("conv_id").cast("string"), lit('"}}'))
    heads = t.select("conv_id").distinct().select("conv_id", F.inline(F.array(F.struct(lit(1).alias("line_number"), head.alias("line")), F.struct(lit(2).alias("line_number"), lit("").alias("line")))))
    return heads.unionByName(body).select(F.concat(lit("conv-"), F.col("conv_id").cast("string")).alias("file"), "line_number", "line")
