"""Model stages, registry, staging and neighbours on the cases that plain queries don't reach."""

import pytest
from pyspark.sql import functions as F

from tidewell.functions import tags, text
from tidewell.operators import curate, models, neighbours, tagging
from tidewell.sources import datasets
from tidewell.sources import models as registry
from tidewell.streaming import stages


def apply(spark, fn, rows):
    return [r.y for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i long, x string").orderBy("i").select(fn(F.col("x")).alias("y")).collect()]


def test_hostile_answers_cost_one_row_only(spark):
    given = ['{"intent": "\\ud800", "knowledge": "k", "difficulty": "easy"}', "[" * 100_000, '{"intent": 1, "knowledge": NaN, "difficulty": "easy"}', '{"a": 1, "a": 2, "intent": "i", "knowledge": null, "difficulty": "d"}']
    assert [r.ok for r in apply(spark, lambda c: tags.parse_tags(c, "difficulty"), given)] == [False, False, True, True]


def test_a_missing_model_fails_whatever_is_selected(spark):
    reg = spark.createDataFrame([("a", ["x"], None, None, None, None, None, None, None, None)], registry.SCHEMA)
    rows = spark.createDataFrame([("a", 1), ("zzz", 2)], "model_name string, n int")
    for ask in (lambda d: d.select("stop_tokens").collect(), lambda d: d.count()):
        with pytest.raises(Exception, match="no such model"):
            ask(registry.with_model(rows, reg))
    known = registry.with_model(rows.where("n = 1"), reg)
    assert known.count() == 1 and known.select(registry.stop_list(True).alias("s")).first().s == ["x", "\n"]
    with pytest.raises(Exception, match="has no pre_query_template_math"):
        known.select(registry.template("math")).collect()


def test_families_of_whole_model_names_are_sanitised(spark):
    for family, n in (("google/gemma-2-9b-it", 6.1), ("meta-llama/Llama-3.1-8B", 99.1), ("gemma-1.1", 0.0)):
        assert apply(spark, lambda c, f=family: text.sanitize(c, f), ["Why? x"])[0]["class"] == n


def test_keywords_with_capitals(spark):
    assert apply(spark, lambda c: text.has_keyword(c, text.CODE_KEYWORDS), ["I write PYTHON", "c++ here", "hum"]) == [True, True, False]
    assert apply(spark, lambda c: text.has_keyword(c, ["Python"], False), ["Python", "python"]) == [True, False]


def test_missing_or_differing_generators_are_errors(spark):
    for made, answered, why in ((None, None, "missing"), ("m", None, "missing"), ("m", "n", "differ"), ("x", "x", "prefix")):
        rows = models.instructions(spark, models.StubGenerator, "t", 1, 1)
        rows = tagging.instruction_rows(rows, "t", "g", 1, 1, 1).withColumn("file_idx", F.lit(0)).withColumn("gen_input_configs", F.col("gen_input_configs").withField("input_generator", F.lit(made).cast("string")))
        rows = rows.withColumn("gen_response_configs", F.struct(F.lit(answered).cast("string").alias("output_generator")))
        for c in curate.COLUMNS:
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast("string"))
        with pytest.raises(Exception, match=why):
            curate.to_conversations(rows, "m").collect()


def test_a_stage_refuses_null_keys_and_removes_itself(spark, tmp_path):
    path = str(tmp_path / "stage")
    with pytest.raises(ValueError, match="null"):
        stages.run_stage(spark.createDataFrame([(1,), (None,)], "row_idx long"), lambda d: d, path)
    assert stages.run_stage(spark.range(3).withColumnRenamed("id", "row_idx"), lambda d: d, path).count() == 3
    stages.finish(spark, path)
    assert not (tmp_path / "stage").exists()


def test_generation_keeps_wide_integers_and_strips(spark):
    class Padded:
        def generate(self, prompts, seeds):
            return [f" \n{p}{s} " for p, s in zip(prompts, seeds, strict=True)]

    rows = spark.createDataFrame([(2**53 + 1, "a", None), (2**53 + 2, None, 5)], "id long, p string, n long")
    got = {r.id: (r.out, r.n) for r in models.generate(rows, Padded, "p", "id", "out").collect()}
    assert got == {2**53 + 1: (f"a{2**53 + 1}", None), 2**53 + 2: (str(2**53 + 2), 5)}


def test_only_request_errors_are_retried(monkeypatch):
    calls = []

    def fails(error):
        def call(*args):
            calls.append(args)
            raise error

        return call

    monkeypatch.setattr(datasets.with_retry, "__defaults__", (5, lambda s: None, (Exception,)))
    monkeypatch.setattr(datasets, "chat_completion", fails(TimeoutError()))
    assert datasets.ChatClient("http://x", {}, 1.0).complete([], {}) is None and len(calls) == 5 and calls[0][-1] == 1.0
    monkeypatch.setattr(datasets, "chat_completion", fails(KeyError("choices")))
    with pytest.raises(KeyError):
        datasets.ChatClient("http://x", {}).complete([], {})


def test_api_answers_and_rewards(spark):
    rows = spark.createDataFrame([(1, "sevensx", ["a", "b"]), (2, None, []), (3, "ok", None)], "id long, p string, r array<string>")
    got = {r.id: (r.responses, r.ok) for r in tagging.api_responses(rows, tagging.StubClient, "p", {}, 2).collect()}
    assert got[1] == (["", ""], False) and got[2] == (["", ""], False) and got[3][1] and len(set(got[3][0])) == 2
    got = {r.id: r.rewards_armorm for r in tagging.preference_rewards(rows, tagging.StubScorer, "p", "r").collect()}
    assert [len(got[i]) for i in (1, 2, 3)] == [2, 0, 0]


def test_neighbours_of_string_ids_and_null_vectors(spark):
    rows = [("b", [0.0]), ("a", [0.1]), ("z", None), ("c", [5.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    for block in (4, 1 << 20):
        got = {(r.id, r.nid): r["rank"] for r in neighbours.nearest(df, 2, block_bytes=block).collect()}
        assert got == {("b", "b"): 1, ("b", "a"): 2, ("a", "a"): 1, ("a", "b"): 2, ("c", "c"): 1, ("c", "a"): 2}
    assert neighbours.nearest(df.limit(0), 2).count() == 0
    full = spark.createDataFrame([(0, "x", [0.0]), (1, "y", [0.1]), (2, "w", None)], "row_idx long, conversation_id string, embedding array<float>")
    got = {r.row_idx: (r.conversation_id, r.repeat_count, r.min_similar_conversation_id) for r in neighbours.near_duplicate_rows(full).collect()}
    assert got == {0: ("x", 1, "x"), 1: ("y", 1, "x"), 2: ("w", None, None)}


def test_arguments_and_names():
    for bad in ({"total": 1, "model": "qwen", "sanitize": True}, {}, {"total": 1, "turns": 1}, {"total": 1, "logits_processor": True, "flaming_tokens": True}, {"total": 1, "api": True, "mission": "safety"}):
        with pytest.raises(ValueError):
            tagging.check_arguments(**bad)
    tagging.check_arguments("google/Gemma-2", True, 1, None, 2, api=True, mission="quality")
    assert tagging.job_name("org/m", 10, 1.0, 0.9, 7) == "m_topp1_temp0.9_10_7"


def test_answers_that_break_off_or_are_not_json_are_retried(monkeypatch):
    import http.client
    import json

    for error in (http.client.IncompleteRead(b"x"), json.JSONDecodeError("no", "x", 0)):
        calls = []

        def call(*args, error=error, calls=calls):
            calls.append(args)
            if len(calls) < 3:
                raise error
            return "said"

        monkeypatch.setattr(datasets.with_retry, "__defaults__", (5, lambda s: None, (Exception,)))
        monkeypatch.setattr(datasets, "chat_completion", call)
        assert datasets.ChatClient("http://x", {}).complete([], {}) == "said" and len(calls) == 3
