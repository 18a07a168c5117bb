"""Shards of different stages read together: their schemas form a lattice, and all are read with its least upper bound.

Order of types: a field without any value is below everything, long below decimal below double,
arrays, maps and structs by their parts, where a struct with more fields is above one with fewer.
Other types have no upper bound: a conflict, which is an error that names field, types and files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .datasets import read_dataset, read_shards

_CONFIG = "gen_input_configs struct<temperature:double,top_p:double,input_generator:string,seed:bigint>"
_ANSWER = "gen_response_configs struct<prompt:string,temperature:double,top_p:double,repetition_penalty:double,max_tokens:bigint,stop_tokens:array<string>,output_generator:string,engine:string>"
#: The columns each stage adds to a row, in the order of the stages (further turns, instruction_k and response_k, aside).
STAGES = {
    "instructions": f"id bigint, pre_query_template string, instruction string, created bigint, {_CONFIG}",
    "responses": f"response string, {_ANSWER}",
    "difficulty": "intent string, knowledge string, difficulty string, difficulty_generator string",
    "quality": "input_quality string, quality_explanation string, quality_generator string",
    "classification": "task_category string, other_task_category array<string>, task_category_generator string",
    "safety": "llama_guard_2 string",
    "reward": "instruct_reward double, reward_model string",
    "language": "language string",
}


class Conflict(ValueError):
    """Two shards have types for a field that no type can hold both."""

    def __init__(self, field: str, a: T.DataType, b: T.DataType):
        super().__init__(f"field {field}: {a.simpleString()} and {b.simpleString()}")
        self.field, self.types = field, (a, b)


def stage_schema(*names: str) -> T.StructType:
    """The columns of these stages together."""
    fields = [f for n in names for f in T.StructType.fromDDL(STAGES[n])]
    return T.StructType(fields)


def missing(schema: T.StructType, stage: str) -> list[str]:
    """Columns of the stage that a schema lacks."""
    have = {f.name.lower() for f in schema}
    return [f.name for f in stage_schema(stage) if f.name.lower() not in have]


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _digits(t: T.DataType) -> tuple[int, int]:
    """Digits before and after the point."""
    return (t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (19, 0)


def upper(a: T.DataType, b: T.DataType, field: str = "") -> T.DataType:
    """The least type that holds both; all parts nullable. Fields stand in the order of a, then b's others; names that differ in case only are a conflict."""
    if a == b and not isinstance(a, (T.StructType, T.ArrayType, T.MapType)):
        return a
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        one = b if isinstance(a, T.NullType) else a
        return one if isinstance(one, T.NullType) else upper(one, one, field)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return _struct(a, b, field)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(upper(a.elementType, b.elementType, f"{field}[]"), True)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType) and a.keyType == b.keyType:
        return T.MapType(a.keyType, upper(a.valueType, b.valueType, f"{field}{{}}"), True)
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
            return max(a, b, key=lambda t: [type(t) is w for w in _WHOLE].index(True))
        whole, part = (max(x) for x in zip(_digits(a), _digits(b), strict=True))
        floats = isinstance(a, (T.FloatType, T.DoubleType)) or isinstance(b, (T.FloatType, T.DoubleType))
        return T.DoubleType() if floats or whole + part > 38 else T.DecimalType(whole + part, part)
    raise Conflict(field, a, b)


def _struct(a: T.StructType, b: T.StructType, field: str) -> T.StructType:
    at: dict[str, T.StructField] = {}
    for f in [*a, *b]:
        name = f"{field}.{f.name}" if field else f.name
        known = at.get(f.name.lower())
        if known and known.name != f.name:
            raise Conflict(f"{name} (also {known.name})", known.dataType, f.dataType)
        at[f.name.lower()] = T.StructField(f.name, upper(known.dataType if known else f.dataType, f.dataType, name), True)
    return T.StructType(list(at.values()))


def emptied(full: T.DataType, known: T.DataType | None) -> T.DataType:
    """The inferred type full with the null type for what known, the type inferred without fields that are always null or empty, doesn't have."""
    if known is None:
        return T.ArrayType(T.NullType()) if isinstance(full, T.ArrayType) else T.NullType()
    if isinstance(full, T.StructType) and isinstance(known, T.StructType):
        have = {f.name: f.dataType for f in known}
        return T.StructType([T.StructField(f.name, emptied(f.dataType, have.get(f.name))) for f in full])
    if isinstance(full, T.ArrayType) and isinstance(known, T.ArrayType):
        return T.ArrayType(emptied(full.elementType, known.elementType))
    return full


def joined(found: list[tuple[str, T.StructType]], again: Callable[[str], T.StructType] | None = None) -> T.StructType:
    """The least upper bound of the files' schemas. Where two conflict, `again` gives a closer look at a file, which replaces its schema; a conflict that stays names both files."""
    looked: dict[str, T.StructType] = {}
    bound, since = T.StructType([]), []
    for path, schema in found:
        try:
            bound = upper(bound, schema)
        except Conflict:
            if again:
                for p, _ in [*since, (path, schema)]:
                    looked.setdefault(p, again(p))
            bound = T.StructType([])
            for p, s in [*since, (path, schema)]:
                try:
                    bound = upper(bound, looked.get(p, s))
                except Conflict as c:
                    raise ValueError(f"{c}: {_first_against(since, looked, looked.get(p, s))} and {p} disagree") from c
        since.append((path, schema))
    return bound


def _first_against(before: list[tuple[str, T.StructType]], looked: dict[str, T.StructType], schema: T.StructType) -> str:
    for p, s in before:
        try:
            upper(looked.get(p, s), schema)
        except Conflict:
            return p
    return "the files before"


def _settled(t: T.DataType) -> T.DataType:
    """Fields without a value anywhere are read as strings."""
    if isinstance(t, T.NullType):
        return T.StringType()
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _settled(f.dataType)) for f in t])
    return T.ArrayType(_settled(t.elementType)) if isinstance(t, T.ArrayType) else t


def read_stages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Shards of any stages by name, with file_idx; columns a shard lacks are null there.

    Each file's schema is inferred in a scan by Spark, over all its rows. Inference calls a field
    that is always null a string; where such a field could be the cause of a conflict, the files
    up to it are looked at a second time without fields that never have a value. Only schemas come
    to the driver.
    """

    def again(path: str) -> T.StructType:
        return emptied(seen[path], read_dataset(spark, path, options={"dropFieldIfAllNull": True}).schema)

    seen = {p: read_dataset(spark, p).schema for p in paths}
    return read_shards(spark, paths, _settled(joined([(p, seen[p]) for p in paths], again)))
