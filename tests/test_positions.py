"""Dense positions, rank selection and exactly-once stages."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import curate, positions
from tidewell.sources import datasets
from tidewell.streaming import stages


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_numbered_is_dense_and_the_same_for_any_partitioning(spark, partitions):
    r = random.Random(1)
    rows = [(k, r.choice(["a", "a", "b", None]), f"x{k}") for k in r.sample(range(-500, 9_000_000), 700)] + [(None, "c", "y")]
    df = spark.createDataFrame(rows, "key long, file string, id2 string").repartition(partitions)
    got = {(x.file, x.key): x.id for x in positions.numbered(df, "key", "file", block=64).collect()}
    want = {}
    for f in ("a", "b", "c", None):
        for i, k in enumerate(sorted((k for k, g, _ in rows if g == f), key=lambda k: (k is not None, k or 0))):
            want[f, k] = i
    assert got == want


def test_no_window_takes_a_whole_file(spark):
    plan = _plan(positions.numbered(spark.range(10).withColumn("f", F.lit(1)), "id", "f", "n"))
    windows = [x for x in plan.splitlines() if "Window [row_number()" in x]
    assert windows and all("_block" in x for x in windows)


@pytest.mark.parametrize("split", ["64m", "2k"])
def test_rows_of_files_are_numbered_in_file_order(spark, tmp_path, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        paths = []
        for i, n in enumerate((300, 0, 500)):
            paths.append(str(tmp_path / f"{i}.jsonl"))
            with open(paths[-1], "w") as f:
                f.writelines(f'{{"a": {i * 1000 + j}, "t": "{"x" * (j % 50)}"}}\n' for j in range(n))
        got = positions.read_numbered(spark, paths, "a long, t string").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(i * 1000 + j, i, j) for i, n in enumerate((300, 0, 500)) for j in range(n)]
    assert sorted((r.row_idx, r.a, r.file_idx, r.id) for r in got) == [(k, *x) for k, x in enumerate(want)]


@pytest.mark.parametrize("n", [0, 1, 5, 60, 119, 120, 121, 260, 299, 300, 1000])
def test_top_by_equals_sorting(spark, n):
    r = random.Random(2)
    rows = [(i * 7_000_000_007 - 10**12, "x" * (40 if i % 3 == 0 else r.choice([0, 3, 900, 5000]))) for i in range(300)]
    df = spark.createDataFrame(rows, "row_idx long, response string").repartition(5)
    out = curate.longest(df, n)
    assert [x.row_idx for x in out.collect()] == [k for k, t in sorted(rows, key=lambda x: (-len(x[1]), x[0]))[:n]]
    assert "TakeOrderedAndProject" not in _plan(out)


def test_top_by_with_equal_and_null_ties(spark):
    rows = [(1, "aa")] * 4 + [(None, "aa")] * 3 + [(2, None), (0, "a"), (5, "aaa")]
    df = spark.createDataFrame(rows, "row_idx long, response string")
    for n, want in ((1, [5]), (3, [5, None, None]), (6, [5, None, None, None, 1, 1]), (9, [5, None, None, None, 1, 1, 1, 1, 0])):
        assert [x.row_idx for x in curate.longest(df, n).collect()] == want
    assert curate.longest(df.limit(0), 3).count() == 0


def test_a_stage_stopped_between_write_and_commit_has_no_row_twice(spark, tmp_path):
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    seen = []

    def doubled(batch):
        seen.append(sorted(r.k for r in batch.select("k").collect()))
        return batch.select("k", (F.col("k") * 2).alias("twice"))

    for part in range(4):
        spark.range(part * 10, part * 10 + 10).select(F.col("id").alias("k")).coalesce(1).write.mode("append").parquet(source)

    def stop(number):
        if number == 2:
            raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        stages.stream_stage(spark, source, "k long", doubled, out, log, files=1, written=stop)
    before = len(seen)
    assert before == 3 and all(len(x) == 10 for x in seen)  # each batch reads its own file
    got = stages.stream_stage(spark, source, "k long", doubled, out, log, files=1)
    assert sorted(map(tuple, got.collect())) == [(k, 2 * k) for k in range(40)]
    assert seen[before] == seen[before - 1] and len(seen) == before + 2  # the open batch again, from the same file, then the last
    spark.range(40, 45).select(F.col("id").alias("k")).coalesce(1).write.mode("append").parquet(source)
    assert stages.stream_stage(spark, source, "k long", doubled, out, log).count() == 45 and seen[-1] == list(range(40, 45))
    assert datasets.output_name("a.json", "response") == "a_res.json"
