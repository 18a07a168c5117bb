"""The reference's own operators against hand-written expectations."""

import json
import re
import uuid

import pytest
from pyspark.sql import functions as F

from tidewell.functions import tags, text
from tidewell.operators import curate, models, neighbours, preference
from tidewell.sources import datasets
from tidewell.sources import models as registry
from tidewell.streaming.stages import run_stage


def apply(spark, fn, rows):
    return [r.y for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i long, x string").orderBy("i").select(fn(F.col("x")).alias("y")).collect()]


def test_remove_prefix(spark):
    given = ["1. x", "a) x", "3.14 is pi", "TASK: x", "**Question** x", "## Prompt: x", "Q12: x", "Question 3. x", "Part 2: x", "é) x", " x ", ""]
    assert apply(spark, text.remove_prefix, given) == ["x", "x", "14 is pi", "x", "x", "x", "x", "x", "x", "x", "x", ""]


@pytest.mark.parametrize("family,given,wanted", [
    ("gemma-2", "*Do* it? yes", ("Do it?", 1.0)), ("gemma-2", '"Why?" he', ("Why?", 2.1)), ("gemma-2", '"One*"\ntwo', ("One", 2.2)), ("gemma-2", "<b>x</b>*", ("<b>x</b>", 3.0)),
    ("gemma-2", "Sum it. The answer is: 4", ("Sum it.", 4.0)), ("gemma-2", "Sum it. Answer: 4", ("Sum it. Answer: 4", 6.2)), ("gemma-2", "Sum. Solution:: 4", ("Sum.", 4.0)),
    ("gemma-2", "List:\na # b", ("List:\na", 5.1)), ("gemma-2", "List:\nWhy? x", ("List:\nWhy?", 5.2)), ("gemma-2", "List*:\nx", ("List:", 5.3)), ("gemma-2", "Why? x", ("Why?", 6.1)), ("gemma-2", "One\ntwo", ("One", 6.2)),
    ("llama-3", "Add. ## Step 1: x", ("Add.", 5.0)), ("llama-3", "List:\na # b", ("List:\na", 6.1)), ("llama-3", "Why? x", ("Why?", 99.1)), ("llama-3", "One\ntwo", ("One", 99.2)),
    ("llama-3", "a) Task: go. The answer is: 4", ("go.", 4.0)), ("other", " x ", (" x ", 0.0)),
])
def test_sanitize(spark, family, given, wanted):
    got = apply(spark, lambda c: text.sanitize(c, family), [given])[0]
    assert (got["instruction"], got["class"]) == wanted


def test_small_text_functions(spark):
    assert apply(spark, lambda c: text.cut_at_stop(c, ["A", "B"]), ["xxByyAzz"]) == ["xx"]
    assert apply(spark, lambda c: text.cut_at_stop(c, ["B", "A"]), ["xxByyAzz"]) == ["xxByy"]
    assert apply(spark, text.repair_tags, ['"a": 1} x', "none"]) == ['{\n"a": 1}', ""]
    assert apply(spark, text.uuid5, ["a", "é"]) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, x)) for x in ("a", "é")]
    got = apply(spark, text.mcq_end, ["A) x B) y C) z D) w", "A) x"])
    assert [(r.is_mcq, r.end) for r in got] == [(True, 17), (False, -1)]
    assert apply(spark, text.next_newline, ["ab\nc", "ab"]) == [2, -1]


def test_tags(spark):
    given = ['{"intent":"a","knowledge":null,"difficulty":"easy"}', '{"intent":"a","knowledge":"k","difficulty":"easy"} x', '{"intent":"a"}', "{'intent':1}", "[]", None]
    got = apply(spark, lambda c: tags.parse_tags(c, "difficulty"), given)
    assert [r.ok for r in got] == [True, False, False, False, False, False]
    assert (got[0].knowledge, got[0].difficulty) == (None, "easy")
    assert apply(spark, lambda c: tags.whitelist(c, tags.CATEGORY), ["Math", "Others", "math", None]) == ["Math", None, None, None]
    with pytest.raises(ValueError):
        tags.prompt("x", F.lit("a"))


def test_selection(spark):
    rows = [(1, "a", "good", -10.0, None), (2, "a", "good", 0.0, 2), (3, "a:", "good", 0.0, 3), (4, "a", "poor", 0.0, 4), (5, "a", "excellent", 1.0, 1), (6, "a", "good", None, 6)]
    df = spark.createDataFrame(rows, "conversation_id long, instruction string, input_quality string, instruct_reward double, min_similar_conversation_id long")
    assert [r.conversation_id for r in curate.high_quality(df).collect()] == [2]


def test_preference(spark):
    df = spark.createDataFrame([("q", ["a", "b", "c"], [1.0, 3.0, 3.0]), ("r", ["a"], [1.0])], "instruction string, responses array<string>, rewards array<double>")
    got = preference.pairs(df).selectExpr("chosen[1].content as c", "rejected[1].content as r").collect()
    assert [(x.c, x.r) for x in got] == [("b", "a"), ("a", "a")]
    assert preference.split(spark.range(101), "id").where("is_test").count() == 3
    with pytest.raises(Exception, match="no rewards"):
        preference.pairs(df.withColumn("rewards", F.array().cast("array<double>"))).collect()


def test_global_ids(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (2, 0), (3, 0)], "file_idx int, id long")
    assert sorted(r.conversation_id for r in curate.global_ids(df, "p").collect()) == ["p_0", "p_1", "p_2", "p_3"]


def test_near_duplicates(spark):
    # A~B, B~C, A not near C; D equals A.
    rows = [(0, [0.0]), (1, [0.2]), (2, [0.4]), (3, [0.0]), (4, [9.0])]
    for block in (64 << 20, 8):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        near = neighbours.nearest(df, 5, block_bytes=block)
        assert near.count() == 25
    got = {r.vec_id: (r.repeat_count, r.representative) for r in neighbours.near_duplicates(df, 0.05).collect()}
    assert got == {0: (2, 0), 1: (3, 0), 2: (1, 1), 3: (2, 0), 4: (0, None)}


def test_io_and_resume(spark, tmp_path):
    p = str(tmp_path / "x.json")
    datasets.write_json_array(spark.createDataFrame([(1, None), (2, "b")], "id long, s string"), p)
    assert json.load(open(p)) == [{"id": 1, "s": None}, {"id": 2, "s": "b"}]
    assert datasets.read_dataset(spark, p, "id long, s string").count() == 2
    datasets.write_jsonl(spark.range(3), str(tmp_path / "y.jsonl"))
    assert datasets.read_shards(spark, [str(tmp_path / "y.jsonl")] * 2).count() == 6
    with pytest.raises(ValueError):
        datasets.read_dataset(spark, "x.csv")
    assert datasets.output_name("a/b.json", "response") == "a/b_res.json" and datasets.output_name("b.json", "", 5) == "b_5res.json"
    waits = []
    assert datasets.with_retry(lambda: 1 / 0, sleep=waits.append) is None and waits == [1, 2, 4, 8, 16]
    src = spark.range(10).withColumnRenamed("id", "row_idx")
    out = str(tmp_path / "stage")
    run_stage(src.where("row_idx < 4"), lambda d: d.withColumn("y", F.col("row_idx") * 2), out)
    assert run_stage(src, lambda d: d.withColumn("y", F.col("row_idx") * 2), out, batches=3).count() == 10


def test_models(spark, tmp_path):
    made = models.instructions(spark, models.StubGenerator, "t", 3, registry.rounds(5, 3))
    assert made.count() == 6
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"org/m-1": {"stop_tokens": ["x"], "stop_tokens_assistant": ["y"], "pre_query_template": "T"}}))
    reg = registry.load_registry(spark, str(p))
    rows = spark.createDataFrame([("org/m-1",)], "model_name string")
    assert registry.with_model(rows, reg).select(registry.stop_list(True).alias("s")).first().s == ["x", "y", "\n"]
    with pytest.raises(Exception, match="no such model"):
        registry.with_model(spark.createDataFrame([("z",)], "model_name string"), reg).collect()
    assert apply(spark, models.language, ["the cat and the dog", "der Hund und die Katze", ""]) == ["EN", "DE", None]
    two = models.turns(spark.createDataFrame([(1, "q", "a")], "id long, instruction string, response string"), models.StubGenerator, 2, "id")
    assert re.fullmatch("[0-9a-f]{12}", two.first().response_2)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_keywords_are_searched_by_one_automaton_in_one_pass(spark):
    odd = ["c++", "f-test", "\n```", ".", "a|b", "é\U0001f600", "(", "\\d"]
    texts = [None, "", "C++", "cpp", "F-TEST", "ftest", "x\n```", "x```", "nothing", "a|b", "ab", "É\U0001f600", "é", "5", "\\D", "\x00(", "tangen t", "a TANGENT b"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for words in (odd, text.MATH_KEYWORDS, text.CODE_KEYWORDS, [""]):
        found = rows.select("i", text.has_keyword(F.col("t"), words).alias("x"))
        assert [r.x for r in found.orderBy("i").collect()] == [None if t is None else any(w.lower() in t.lower() for w in words) for t in texts]
        assert "exists(" not in found._jdf.queryExecution().optimizedPlan().toString()  # which tries word after word
    assert [r.x for r in rows.select(text.has_keyword(F.col("t"), []).alias("x")).distinct().collect()].count(True) == 0
