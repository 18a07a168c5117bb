"""What the operators share: the shared folder, staged tables, batch helpers."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared
from ..sources.shared import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_STAGED = threading.local()


def _mine() -> list[str]:
    """What this thread has staged and not removed."""
    if not hasattr(_STAGED, "paths"):
        _STAGED.paths = []
    return _STAGED.paths


def staged_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _mine().append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts lineage and survives the loss of executors."""
    path = staged_path(df.sparkSession, name)
    df.write.option("parquet.block.size", 16 << 20).parquet(path)  # smaller row groups: less is held while writing
    return df.sparkSession.read.schema(df.schema).parquet(path)


def last_staged() -> str:
    """Where this thread's last staged table that is still there lies."""
    return _mine()[-1]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what is staged at a path; no error if it is gone."""
    shared.remove(spark, path)
    with contextlib.suppress(ValueError):
        _mine().remove(path)


@contextlib.contextmanager
def scratch(spark: SparkSession, keep: Callable[[], list[DataFrame]] = list) -> Iterator[None]:
    """Tables that this thread stages inside go when it ends, all of them if it fails, else but for those that the DataFrames of keep() read; nothing that is evaluated later may read the others."""
    before, needed = list(_mine()), set()
    try:
        yield
        needed = {f.rpartition("/")[0] for df in keep() for f in df.inputFiles()}
    finally:
        for path in [p for p in _mine() if p not in before]:
            if not any(f.endswith(path.split(":", 1)[-1].lstrip("/")) for f in needed):
                remove(spark, path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Sets the session to Arrow batches of so many rows, unless it has a number of its own: ten thousand texts at once take much memory on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def in_blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text columns hold about `limit` bytes at most, so that memory doesn't follow the batch size; one longer text is a block of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def by_blocks(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text", limit: int = 8 << 20) -> DataFrame:
    """mapInArrow over blocks of bounded bytes."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in in_blocks(batches, text, limit):
            out = fn(block)
            if out is not None and out.num_rows:
                yield out
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def ascii_lower(col):
    """Lower-cases A-Z only. Where a text has no other cased letter, lower() gives the same and is many times faster."""
    # \p{Cn}: letters newer than the pattern engine's tables, which lower() may know.
    return F.when(~col.rlike(r"[[\p{IsUppercase}\p{IsTitlecase}\p{Cn}]&&[^A-Z]]"), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(id_col: Column, *cols: Column) -> Column:
    """What tells rows apart that share an id: the id and 128 bits of hashes of other columns."""
    return F.struct(id_col.alias("id"), F.xxhash64(*cols).alias("h"), F.xxhash64(F.lit(7), *cols).alias("g"))


def without(docs: DataFrame, key: Column, dropped: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """docs without the rows whose key is in `dropped` (one column `gone`), which is broadcast only while its counted size is within the bound. Keys are compared as hashes of two seeds beside the value, so that null ids count as equal."""
    at, of = fresh(docs, "_key"), fresh(docs, "_gone")
    gone = staged(dropped.select(F.col("gone").alias(of)).distinct(), "dropped")
    if gone.count() * 40 <= broadcast_bytes:
        gone = F.broadcast(gone)
    return docs.withColumn(at, key).join(gone, F.col(at).eqNullSafe(F.col(of)), "left_anti").drop(at)


def packed(src: DataFrame, text: str, limit: int) -> DataFrame:
    """block, body: consecutive rows of src with about `limit` bytes of text together, as one compressed Arrow stream; a longer text is alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, held, size = TaskContext.get().partitionId(), 0, [], 0
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))

        def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as w:
                for b in held:
                    w.write_batch(b)
            return pa.record_batch([pa.array([part << 32 | no], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "body"])

        for b in in_blocks(batches, text, limit):
            more = pc.sum(pc.binary_length(b.column(text))).as_py() or 0
            if held and size + more > limit:
                yield row(held)
                no, held, size = no + 1, [], 0
            held.append(b)
            size += more
        if held:
            yield row(held)

    small_batches(src.sparkSession)
    return src.mapInArrow(run, "block long, body binary")


def unpacked(body: pa.Scalar, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of a block, in slices of about `limit` bytes of text."""
    yield from in_blocks(iter(pa.ipc.open_stream(body.as_buffer())), text, limit)
    pa.default_memory_pool().release_unused()
