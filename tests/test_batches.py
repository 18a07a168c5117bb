"""Model batches of bounded bytes, and stages that leave a user's columns alone."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.operators import batches, models, tagging


@pytest.fixture
def bounded():
    class Bounded:
        """Answers with its prompt's length and seed; fails on a batch beyond the bound."""

        def generate(self, prompts, seeds):
            sizes = [len(p.encode()) for p in prompts]
            assert len(prompts) == 1 or sum(sizes) <= 5_000, sum(sizes)
            assert sizes == sorted(sizes)
            return [f"{n}:{s}" for n, s in zip(sizes, seeds, strict=True)]

    return Bounded


def test_packs_hold_all_rows_within_the_bound():
    sizes = [5, 900, 0, 30, 30, 30, 4000, 1, 2]
    got = list(batches.packs(sizes, 60, 4))
    assert sorted(i for p in got for i in p) == list(range(len(sizes)))
    assert all(len(p) <= 4 and (len(p) == 1 or sum(sizes[i] for i in p) <= 60) for p in got)


def test_no_batch_exceeds_the_bound_over_whole_documents(spark, bounded):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").where("length(text) > 3000 or doc_id % 50 = 0")
    out = models.generate(docs, bounded, "text", "doc_id", "made", 5_000)
    assert out.select(F.octet_length("text").alias("n"), "doc_id", "made").where("made <> n || ':' || doc_id").isEmpty()
    assert out.agg(F.max(F.octet_length("text"))).first()[0] > 100_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan


def test_null_prompts_and_keys(spark, bounded):
    df = spark.createDataFrame([(1, None), (None, "ab"), (3, "c")], "id long, p string")
    assert sorted(r.made for r in models.generate(df, bounded, "p", "id", "made").collect()) == ["0:1", "1:3", "2:None"]


def test_stages_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "q", "a", "mine", 7, "x", [1.0])], "id long, instruction string, response string, _ask string, _answer int, _tags string, _chats array<double>")
    names = ["_ask", "_answer", "_tags", "_chats"]
    kept = ["mine", 7, "x", [1.0]]
    for out in (
        tagging.tag(df, lambda: tagging.StubTagger("difficulty"), "difficulty", "t"), tagging.safety(df, models.StubGenerator), tagging.reward(df, tagging.StubScorer, "m"), models.turns(df, models.StubGenerator, 2, "id"),
        tagging.preference_rewards(df.withColumn("responses", F.array("response")), tagging.StubScorer), tagging.api_responses(df, tagging.StubClient, "instruction", {}),
    ):
        (row,) = out.collect()
        assert [row[n] for n in names] == kept


def test_api_rows_in_flight_are_bounded(spark):
    class Counting:
        now = 0

        def complete(self, messages, params):
            Counting.now += 1
            assert Counting.now <= 4
            import time

            time.sleep(0.001)
            Counting.now -= 1
            return messages[0]["content"].upper()

    df = spark.range(50).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("p"))
    got = tagging.api_responses(df, Counting, "p", {}, threads=4).collect()
    assert all(r.ok and r.responses == [r.p.upper()] for r in got) and len(got) == 50


def test_model_calls_keep_arrow_batches_small_unless_the_session_says_otherwise(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        rows = spark.range(0, 4000, 1, 1).select(F.col("id"), F.repeat(F.lit("x"), 10_000).alias("t"))  # 40 MB
        assert rows.select(batches.asked(lambda: lambda p, k: [len(x) for x in p], "long", F.col("t")).alias("n")).distinct().collect()[0].n == 10_000
        sizes = rows.mapInArrow(lambda bs: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in bs), "n long").collect()
        assert max(r.n for r in sizes) < 8 << 20
        spark.conf.set(name, "1000000")
        batches.small_batches(spark)
        assert spark.conf.get(name).rstrip("b") == "1000000"
    finally:
        spark.conf.set(name, before)
