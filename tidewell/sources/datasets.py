"""Instruction files in and out: JSON arrays, JSON lines, suffix dispatch, numbered shards."""

from __future__ import annotations

import http.client
import json
import os
import re
import time
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType, _parse_datatype_string

from .json_array import JsonArraySource

#: Rows of the generation stage, and of the response stage.
INSTRUCTIONS = """id long, pre_query_template string, raw_instruction string, instruction string,
instruction_sanitize_class_num double, response string, created long,
gen_input_configs struct<temperature:double,top_p:double,input_generator:string,seed:bigint>,
gen_response_configs struct<prompt:string,temperature:double,top_p:double,repetition_penalty:double,max_tokens:bigint,stop_tokens:array<string>,output_generator:string,engine:string>"""


def read_json_array(spark: SparkSession, path: str, schema=None, options: dict | None = None) -> DataFrame:
    """A file that holds one JSON array of records. With a schema and no options, an array in the layout of write_json_array is read in splits; any other is read by one task."""
    indent = _layout(spark, path) if schema is not None and not options else None
    if indent is not None:
        return _read_split_array(spark, path, schema, indent)
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST").options(**options or {})
    return (reader.schema(schema) if schema else reader).json(path)


def _layout(spark: SparkSession, path: str) -> str | None:
    """The indentation of the records of an array file that opens and closes in the layout of write_json_array: brackets, and the records' outer braces, alone in their lines. Only both ends of the file are read; None for anything else."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at) or not files.isFile(at):
        return None
    size, ends = files.getFileStatus(at).getLen(), []
    for start in (0, max(0, size - 64)):
        stream = files.open(at)
        try:
            stream.seek(start)
            ends.append(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(64, size))))
        finally:
            stream.close()
    head = re.match(rb"\[\n([ \t]+)\{\n", ends[0])
    if head and re.search(rb"\n" + head[1] + rb"\}\n\]\s*\Z", ends[1]):
        return head[1].decode()
    return None


def _read_split_array(spark: SparkSession, path: str, schema, indent: str) -> DataFrame:
    """Valid JSON has no raw line break inside a string, so a line that holds the indentation and a closing brace ends a record, and Spark can split the file there. Each piece is parsed as an array of its own: where a file leaves the layout, a piece is either several whole records or fails."""
    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    pieces = spark.read.option("lineSep", f"\n{indent}}}").text(path).where(~F.col("value").rlike(r"\A\s*\]\s*\z"))
    body = F.concat(F.lit("["), F.regexp_replace("value", r"\A[\[,]", ""), F.lit("}]"))
    return pieces.select(F.from_json(body, ArrayType(kind), {"mode": "FAILFAST"}).alias("rows")).selectExpr("inline(rows)")


def read_jsonl(spark: SparkSession, path: str, schema=None, options: dict | None = None) -> DataFrame:
    """One record a line; a bad line fails the read."""
    reader = spark.read.option("mode", "FAILFAST").options(**options or {})
    return (reader.schema(schema) if schema else reader).json(path)


def read_dataset(spark: SparkSession, path: str, schema=None, options: dict | None = None) -> DataFrame:
    """By suffix, .json or .jsonl; anything else is an error."""
    kind = os.path.splitext(path)[1]
    if kind == ".json":
        return read_json_array(spark, path, schema, options)
    if kind == ".jsonl":
        return read_jsonl(spark, path, schema, options)
    raise ValueError(f"unknown dataset suffix {kind!r}: use .json or .jsonl")


def read_shards(spark: SparkSession, paths: list[str], schema=None) -> DataFrame:
    """One scan per file, with its place in the list as file_idx."""
    frames = [read_dataset(spark, p, schema).withColumn("file_idx", F.lit(i)) for i, p in enumerate(paths)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with null fields kept; a re-run replaces rather than appends."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def concatenate(spark: SparkSession, paths: list[str], to: str, schema=None) -> DataFrame:
    """All shards in one JSON-lines folder, in place of what was there; returns it as read back."""
    rows = read_shards(spark, paths, schema).drop("file_idx")
    write_jsonl(rows, to)
    return read_jsonl(spark, to, rows.schema)


def write_json_array(df: DataFrame, path: str, max_rows: int | None = None) -> None:
    """One indented array in one file, in place of what is there, in the order of df's partitions. Tasks write the text and the commit joins it, so any number of rows will do; path must be reachable for driver and executors. More than max_rows, if given, is an error."""
    if max_rows is not None and df.count() > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    df.sparkSession.dataSource.register(JsonArraySource)
    df.write.format("json_array").mode("overwrite").save(path)


SUFFIX = {"response": "res", "multi_turn": "mt", "reward_pairs": "armorm", "classification": "category"}


def output_name(path: str, stage: str, n: int | None = None) -> str:
    """<stem>_<suffix>.json for a stage; with n, <stem>_<n>res.json."""
    stem = os.path.splitext(path)[0]
    return f"{stem}_{n}res.json" if n is not None else f"{stem}_{SUFFIX.get(stage, stage)}.json"


def with_retry(call: Callable[[], str], retries: int = 5, sleep: Callable[[float], None] = time.sleep, errors: tuple[type[BaseException], ...] = (Exception,)) -> str | None:
    """The call's result; after each failure of the given kinds it waits 2^attempt seconds; None after the last."""
    for attempt in range(retries):
        try:
            return call()
        except errors:
            sleep(2**attempt)
    return None


class ChatClient:
    """A chat API by HTTP, with retries of failed requests only: errors of the connection (timeouts among them), answers that break off, bodies that aren't JSON."""

    def __init__(self, endpoint: str, headers: dict, timeout: float = 600.0):
        self.endpoint, self.headers, self.timeout = endpoint, headers, timeout

    def complete(self, messages: list[dict], params: dict) -> str | None:
        return with_retry(lambda: chat_completion(messages, params, self.endpoint, self.headers, self.timeout), errors=(OSError, http.client.HTTPException, json.JSONDecodeError))


def chat_completion(messages: list[dict], params: dict, endpoint: str, headers: dict, timeout: float = 600.0) -> str:
    """One HTTP chat completion."""
    body = json.dumps({**params, "messages": messages}).encode()
    with urllib.request.urlopen(urllib.request.Request(endpoint, body, {"Content-Type": "application/json", **headers}), timeout=timeout) as r:
        return json.load(r)["choices"][0]["message"]["content"]
