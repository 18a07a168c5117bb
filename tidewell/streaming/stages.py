"""Resumable stages: by the keys that a Parquet folder holds already, or as exactly-once micro-batches over a folder of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.curate import resume
from ..sources.shared import remove


def run_stage(source: DataFrame, stage: Callable[[DataFrame], DataFrame], path: str, key: str = "row_idx", batches: int = 1) -> DataFrame:
    """The staged output of all source rows; batches already in the folder aren't computed again."""
    spark = source.sparkSession
    if not source.where(F.col(key).isNull()).isEmpty():
        raise ValueError(f"{key} is null in some rows: a restart couldn't tell whether they are done")
    for i in range(batches):
        part = source.where(F.pmod(F.xxhash64(key), F.lit(batches)) == i)
        try:
            done = spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            done = None  # nothing staged yet
        rest = resume(part, done, key)
        if not rest.isEmpty():
            stage(rest).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def stream_stage(spark: SparkSession, source: str, schema, stage: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files: int = 64, kind: str = "parquet", written: Callable[[int], None] = lambda batch: None) -> DataFrame:
    """The staged output of all files in `source`, each row once, however often the stage is stopped and called again.

    A micro-batch takes up to `files` new files, which the checkpoint's log names before the
    batch begins, and reads nothing else. Its rows replace the folder of its number, so a batch
    that was written but not committed is written anew, from the same files, in the same place;
    one that is committed is never read again. Files that arrive later are taken by the next
    call. `written` is called between a batch's output and its commit. A stage whose answers
    vary must take its seed from the row.
    """

    def write(batch: DataFrame, number: int) -> None:
        stage(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        written(number)

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(source)
    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    try:
        return spark.read.parquet(out).drop("batch")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return stage(spark.createDataFrame([], schema))  # no file yet


def finish(spark: SparkSession, path: str) -> None:
    """Removes a stage's folder once its output is written elsewhere."""
    remove(spark, path)
