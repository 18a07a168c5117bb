"""Dense positions and rank selection without a single task: prefix sums over block counts, cut-offs from histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.datasets import read_dataset
from ..sources.shared import remove, written

#: Keys of a block, and blocks of a run of blocks.
BLOCK, RUN = 1 << 16, 1 << 10


def hashed(key: str, seed: int = 42) -> Column:
    """A row's rank in a shuffle: 60 bits of the SHA-1 of `seed:key`, which other engines can restate. A null key counts as empty."""
    digest = F.sha1(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def numbered(df: DataFrame, key: str, file_col: str, out: str = "id", block: int = BLOCK, tie: str | None = None) -> DataFrame:
    """df with each row's dense position, from 0, among the rows of its file in the order of an integer key.

    Rows meet only in windows over a block of consecutive keys. How many rows stand before a
    block is a prefix sum over counts: over the blocks of a run, and over the runs of a file,
    whose counts are one row for some tens of millions of keys. The result depends on neither
    partitions nor sampling, so a recomputed task gives the same numbers. Rows of equal keys are
    numbered by `tie`, without one in any order; a null key stands first.
    """
    place, run = F.floor(F.coalesce(F.col(key), F.lit(-(1 << 62))) / block), F.floor(F.col("_block") / RUN)
    rows = df.withColumn("_file", F.col(file_col)).withColumn("_block", place)
    counts = rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_run", run)
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("_file", "_run").agg(F.sum("_n").alias("_n")).select("_file", "_run", F.coalesce(F.sum("_n").over(before("_file", "_run")), F.lit(0)).alias("_runs_before"))
    inner = counts.withColumn("_in_run", F.coalesce(F.sum("_n").over(before("_file", "_run", "_block")), F.lit(0)))
    known = lambda a, b, *on: reduce(Column.__and__, [a[c].eqNullSafe(b[c]) for c in on])
    offsets = inner.join(runs, known(inner, runs, "_file", "_run")).select(inner["_file"].alias("_of"), inner["_block"].alias("_at"), (F.col("_in_run") + F.col("_runs_before")).alias("_offset"))
    local = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_file", "_block").orderBy(key, *([tie] if tie else []))) - 1)
    joined = local.join(offsets, F.col("_file").eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_at")))
    return joined.withColumn(out, F.col("_nth") + F.col("_offset")).drop("_file", "_block", "_nth", "_of", "_at", "_offset")


def read_numbered(spark: SparkSession, paths: list[str], schema, broadcast_splits: int = 100_000) -> DataFrame:
    """The rows of the files at paths, in that order, with file_idx, id (dense in its file) and row_idx (dense over all), from 0 and in the files' own order.

    A split of a file is read by one task in order, so a row's place in its split is its running
    number less the split's least one. Splits are counted in a first scan that reads no column;
    the offsets, a row for each split, are prefix sums of the counts.
    """
    scans = [read_dataset(spark, p, schema).withColumn("file_idx", F.lit(i)) for i, p in enumerate(paths)]
    # The files stay apart until they are numbered: a scan's splits are the same whenever it runs.
    marked = [s.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")).withColumn("_row", F.monotonically_increasing_id()) for s in scans]
    counts = reduce(DataFrame.unionByName, [m.groupBy("file_idx", "_path", "_start").agg(F.min("_row").alias("_least"), F.count(F.lit(1)).alias("_n")) for m in marked])
    counts, path = written(counts, "splits")
    order = Window.partitionBy("file_idx").orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    files = counts.groupBy("file_idx").agg(F.sum("_n").alias("_rows")).select("file_idx", F.coalesce(F.sum("_rows").over(Window.orderBy("file_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_files_before"))
    splits = counts.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).join(files, "file_idx").drop("_n")
    if counts.count() <= broadcast_splits:
        splits = F.broadcast(splits)
    rows = reduce(DataFrame.unionByName, [m.join(splits, ["file_idx", "_path", "_start"]).withColumn("id", F.col("_before") + F.col("_row") - F.col("_least")) for m in marked])
    return rows.withColumn("row_idx", F.col("_files_before") + F.col("id")).drop("_path", "_start", "_row", "_least", "_before", "_files_before")


def _bucket(v: Column) -> Column:
    """The least number with the same ten leading bits: 28,673 buckets at most."""
    shift = F.greatest(F.length(F.bin(v)) - 10, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def _cut(counts: list[tuple[int, int]], n: int) -> tuple[int, int] | None:
    """Of (value, rows), values in order of rank: the value at which n rows are reached and how many rows stand before it; None if there are fewer."""
    before = 0
    for value, rows in counts:
        if before + rows >= n:
            return value, before
        before += rows
    return None


def _histogram(df: DataFrame, value: Column, descending: bool) -> list[tuple[int, int]]:
    rows = df.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()  # a bounded number of values, see the callers
    return sorted(((r.v, r.n) for r in rows), reverse=descending)


def top_by(df: DataFrame, value: Column, tie: str, n: int) -> DataFrame:
    """The n rows of greatest value (an integer that isn't negative), ties by the least `tie` (an integer), sorted; rows that agree in both stand for each other.

    Value and tie of all rows are written once. A histogram of value buckets, then of the values
    of the bucket where the n-th row is, gives the cut-off value; where its rows are more than
    are wanted, their tie's cut-off is found the same way, sixteen bits a pass. What is kept is
    then sorted by ranges. So no task and no heap holds n rows, and none sees a hot value alone.
    """
    keys, path = written(df.select(value.cast("long").alias("v"), F.col(tie).cast("long").alias("t")), "ranks")
    try:
        keys = keys.where("v is not null")
        found = _cut(_histogram(keys, _bucket(F.col("v")), True), n)
        if found is None:
            keep = F.lit(True)
        else:
            bucket, before = found
            inside = keys.where(_bucket(F.col("v")) == bucket)
            last, more = _cut(_histogram(inside, F.col("v"), True), n - before)
            wanted = n - before - more
            equal, low = keys.where(F.col("v") == last), -(1 << 63)
            nulls = equal.where("t is null").count()
            most, spare = None, 0
            if wanted > nulls:  # nulls stand first
                wanted -= nulls
                for shift in (48, 32, 16, 0):
                    part = equal.where(F.col("t") >= low) if shift == 48 else equal.where(F.col("t").between(low, low + (1 << shift + 16) - 1))
                    got = _cut(_histogram(part, F.shiftright(F.col("t") - F.lit(low) if shift < 48 else F.col("t"), shift), False), wanted)
                    if got is None:
                        break
                    at, passed = got
                    low = (low if shift < 48 else 0) + (at << shift)
                    wanted -= passed
                    most, spare = low, wanted
                same = equal.where(F.col("t") == most).count() if most is not None else 0
                ties = F.col(tie).isNull() | (F.col(tie) < most if spare < same else F.col(tie) <= most) if most is not None else F.lit(True)
                keep = (value > last) | (value == last) & ties
                if most is not None and spare < same:
                    extra = df.where((value == last) & (F.col(tie) == most)).limit(spare)
                    return df.where(keep).unionByName(extra).orderBy(value.desc(), tie)
            else:
                keep = value > last
                return df.where(keep).unionByName(df.where((value == last) & F.col(tie).isNull()).limit(wanted)).orderBy(value.desc(), tie)
        return df.where(keep).orderBy(value.desc(), tie)
    finally:
        remove(df.sparkSession, path)
