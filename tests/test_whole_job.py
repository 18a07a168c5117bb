"""Registered queries do the whole job: hand-written or brute-force results on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tidewell.plans import registry
from tidewell.sources import models


@pytest.fixture(scope="module")
def long_docs(spark, tmp_path_factory):
    """Documents whose marks all stand after character 200."""
    p, long = str(tmp_path_factory.mktemp("sf")), "word " * 60
    rows = [(3, long + "Why? more"), (7, long + "end\nafter"), (11, long + "so. Solution:: 5"), (0, long + "tail"), (1, long + "tail"), (2, long + "tail"), (19, "List:\n" + long + "a # b"), (27, long + "so. ## Step 1: x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{p}/documents.parquet")
    return p, dict(rows)


def made(i: int, t: str) -> str:
    return ["Task: ", "1. ", "**Question** ", ""][i % 4] + t + ["?", ":\nrest", " The answer is: 4"][i % 3]


def test_derived_texts_are_whole(spark, long_docs):
    p, texts = long_docs
    got = {r.doc_id: r.instruction for r in registry.QUERIES["c2_remove_prefix_whole"](spark, p).collect()}
    assert got == {i: (t + ["?", ":\nrest", " The answer is: 4"][i % 3]).strip() for i, t in texts.items()}
    got = {r.doc_id: (r.instruction, r["class"]) for r in registry.QUERIES["c7_sanitize_other_whole"](spark, p).collect()}
    assert got == {i: (made(i, t), 0.0) for i, t in texts.items()}


def test_sanitised_queries_read_whole_texts(spark, long_docs):
    p, long = long_docs[0], "word " * 60
    gemma, llama = ({r.doc_id: (r.instruction, r["class"]) for r in registry.QUERIES[q](spark, p).collect()} for q in ("c5_sanitize_gemma", "c6_sanitize_llama"))
    assert gemma[3] == (long + "Why?", 6.1) and llama[3] == (long + "Why?", 99.1)
    assert gemma[7] == (long + "end", 6.2) and llama[7] == (long + "end", 99.2)
    assert gemma[11] == llama[11] == (long + "so.", 4.0)
    assert gemma[19] == ("List:\n" + long + "a", 5.1) and llama[19] == ("List:\n" + long + "a", 6.1)
    assert llama[27] == (long + "so.", 5.0)


def test_all_turns_are_widened(spark, tmp_path):
    rows = [(1, 0, "system", "s")] + [(1, 2 * k + i + 1, role, f"{role}{k}") for k in range(5) for i, role in enumerate(("user", "assistant"))][:-1] + [(2, 0, "user", "only")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.asDict() for r in registry.QUERIES["mt_widen_turns_all"](spark, str(tmp_path)).collect()}
    for who, name in (("user", "instruction"), ("assistant", "response")):
        for k in range(5):
            cell = name if k == 0 else f"{name}_{k + 1}"
            assert got[1][cell] == (None if (who, k) == ("assistant", 4) else f"{who}{k}") and got[2][cell] == ("only" if (who, k) == ("user", 0) else None)
    assert len(got[1]) == 11


def test_nearest_of_the_references_k(spark, tmp_path):
    spark.createDataFrame([(i, [float(i * i)]) for i in range(520)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in registry.QUERIES["j1_nearest_500"](spark, str(tmp_path)).collect():
        got.setdefault(r.vec_id, []).append((r.rk, r.nid))
    for i in (0, 7, 300, 519):
        want = sorted(range(520), key=lambda j: ((i * i - j * j) ** 2, j))[:500]
        assert sorted(got[i]) == [(k + 1, j) for k, j in enumerate(want) if j != i]


def test_families_and_api_names(spark):
    wanted = {"x/Llama-3-8B": "llama3", "x/Llama3-8B": "llama3", "x/zephyr-7b": "zephyr", "x/tulu-2": "tulu", "x/Mixtral-8x7B": "mistral", "dolphin-mistral": "mistral", "Yi-34B-Chat": "yi", "zephyr-7b": "zephyr"}
    rows = spark.createDataFrame([(m,) for m in wanted], "m string")
    assert {r.m: r.f for r in rows.select("m", models.family(rows.m).alias("f")).collect()} == wanted
    for name in ("Yi-34B", "phi-3", "deepseek"):
        with pytest.raises(Exception, match="no template for"):
            spark.createDataFrame([(name,)], "m string").select(models.family(F.col("m"))).collect()
    given = ["meta-llama/Meta-Llama-3-8B-Instruct", "meta-llama/Meta-Llama-3-70B-Instruct", "other"]
    rows = spark.createDataFrame([(m,) for m in given], "m string")
    assert {r.m: r.a for r in rows.select("m", models.api_name(rows.m).alias("a")).collect()} == dict(zip(given, ["meta-llama/Llama-3-8b-chat-hf", "meta-llama/Llama-3-70b-chat-hf", "other"], strict=True))
