"""Model calls on columns: only prompts and keys go to Python, in batches of bounded bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of prompts, and prompts, that a model gets at once.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 1_000


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Sets the session to Arrow batches of about so many bytes, unless it has a number of its own: the 64 MB of the default are held more than once, in every worker of a task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).lower() in ("67108864", "67108864b", "64m", "64mb"):
        spark.conf.set(name, str(size))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packs(sizes: list[int], limit: int = BATCH_BYTES, rows: int = BATCH_ROWS) -> Iterator[list[int]]:
    """Indexes in batches: shortest first, so that a batch's prompts are about as long, and no batch above the limits; a larger prompt is alone."""
    part: list[int] = []
    total = 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        if part and (total + sizes[i] > limit or len(part) >= rows):
            yield part
            part, total = [], 0
        part.append(i)
        total += sizes[i]
    if part:
        yield part


def in_packs(call: Callable[[list[str], list], list], prompts: pa.Array, keys: list, limit: int = BATCH_BYTES, rows: int = BATCH_ROWS) -> list:
    """The call's answers to all prompts in their own order; null prompts are read as the empty text."""
    out: list = [None] * len(prompts)
    for part in packs(pc.binary_length(prompts).fill_null(0).to_pylist(), limit, rows):
        got = call([p or "" for p in prompts.take(pa.array(part)).to_pylist()], [keys[i] for i in part])
        if len(got) != len(part):
            raise ValueError(f"a model gave {len(got)} answers to {len(part)} prompts")
        for i, x in zip(part, got, strict=True):
            out[i] = x
    return out


def asked(build: Callable[[], Callable[[list[str], list], list]], kind: str, prompt: Column, key: Column | None = None, limit: int = BATCH_BYTES, rows: int = BATCH_ROWS) -> Column:
    """What a model says to each prompt. build makes the model, once a task: a function of prompts and keys. A row's other columns stay on the JVM."""
    from pyspark.sql.functions import arrow_udf
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_type(_parse_datatype_string(kind))
    small_batches(SparkSession.active())

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        call = build()
        for prompts, keys in batches:
            prompts = prompts.combine_chunks() if isinstance(prompts, pa.ChunkedArray) else prompts
            yield pa.array(in_packs(call, prompts, keys.to_pylist(), limit, rows), arrow)

    return arrow_udf(run, kind).asNondeterministic()(prompt, F.lit(None).cast("long") if key is None else key)


def asked_each(build: Callable[[], Callable[[list[str], list], list]], kind: str, prompts: Column, limit: int = BATCH_BYTES, rows: int = BATCH_ROWS) -> Column:
    """The same for an array of prompts a row: an array of answers."""
    from pyspark.sql.functions import arrow_udf
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_type(_parse_datatype_string(kind))
    small_batches(SparkSession.active())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        call = build()
        for lists in batches:
            flat = lists.flatten()
            ends = pc.list_value_length(lists).fill_null(0).to_pylist()
            at = [0]
            for n in ends:
                at.append(at[-1] + n)
            yield pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(in_packs(call, flat, [None] * len(flat), limit, rows), arrow))

    return arrow_udf(run, f"array<{kind}>").asNondeterministic()(prompts)
