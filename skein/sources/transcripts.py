"""Session transcripts: JSON lines of two shapes to tool calls, file accesses and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "type string, cwd string, sessionId string, timestamp bigint, message struct<content: array<struct<type: string, id: string, name: string, text: string, input: string, tool_use_id: string, content: string>>>"
ROLLOUT = "type string, name string, call_id string, arguments string"
COMMAND = "command array<string>, workdir string"
# Tools that touch a file, by what they do to it.
ACCESS = {"Read": "read", "Write": "write", "Edit": "edit", "NotebookEdit": "edit"}


def tail(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the lines of a folder's files; the query's checkpoint keeps the positions."""
    return spark.readStream.text(folder)


def events(lines: DataFrame) -> DataFrame:
    """session, ts, type, kind, id, name, text, path: the content items of lines (value); what does not parse is left out."""
    parsed = lines.select(F.from_json("value", LINE).alias("l")).where("l.type is not null")
    item = parsed.select(F.col("l.sessionId").alias("session"), F.col("l.timestamp").alias("ts"), F.col("l.type").alias("type"), F.explode_outer("l.message.content").alias("c"))
    path = F.coalesce(F.get_json_object("c.input", "$.file_path"), F.get_json_object("c.input", "$.path"))
    return item.select("session", "ts", "type", F.col("c.type").alias("kind"), F.coalesce("c.id", "c.tool_use_id").alias("id"), F.col("c.name").alias("name"), F.coalesce("c.text", "c.content").alias("text"), path.alias("path"))


def file_accesses(items: DataFrame) -> DataFrame:
    """session, ts, path, op of tool calls that touch a file."""
    op = F.create_map(*[F.lit(x) for pair in ACCESS.items() for x in pair])[F.col("name")]
    return items.where((F.col("kind") == "tool_use") & F.col("path").isNotNull()).select("session", "ts", "path", op.alias("op")).where("op is not null")


def shell_reads(command: Column) -> Column:
    """Paths that a shell command of words reads: the last words of sed -n, cat, head and tail."""
    words = F.array_join(command, " ")
    found = F.regexp_extract_all(words, F.lit(r"(?:^|[;&|]\s*|-lc\s+)(?:cat|head|tail|sed -n)\s+(?:'[^']*'\s+|-\S+\s+|[0-9]+\s+)*([\w./-]+)"), F.lit(1))
    return F.array_distinct(found)


def rollout_accesses(lines: DataFrame) -> DataFrame:
    """call_id, path, op of the second shape: reads of shell commands and the headers of patches."""
    parsed = lines.select(F.from_json("value", ROLLOUT).alias("l")).where("l.type = 'function_call'")
    call = parsed.select("l.call_id", F.from_json("l.arguments", COMMAND).alias("a"))
    patch = F.regexp_extract_all(F.array_join("a.command", "\n"), F.lit(r"\*\*\* (?:Update|Add|Delete) File: (\S+)"), F.lit(1))
    ops = F.concat(F.transform(shell_reads(F.col("a.command")), lambda p: F.struct(p.alias("path"), F.lit("read").alias("op"))), F.transform(patch, lambda p: F.struct(p.alias("path"), F.lit("edit").alias("op"))))
    return call.select("call_id", F.explode(ops).alias("x")).select("call_id", "x.path", "x.op")
