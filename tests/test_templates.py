"""Template programs against prompts written out by hand."""

import pytest
from pyspark.sql import functions as F

from tidewell.operators import templates

SAYS = [("system", " S "), ("user", "u1 "), ("assistant", " a1"), ("user", "u2")]
#: The chat above by family, the assistant's turn opened.
WANTED = {
    "llama3": "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nS<|eot_id|><|start_header_id|>user<|end_header_id|>\n\nu1<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\na1<|eot_id|><|start_header_id|>user<|end_header_id|>\n\nu2<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n",
    "gemma": "<bos><start_of_turn>user\nS\n\nu1<end_of_turn>\n<start_of_turn>model\na1<end_of_turn>\n<start_of_turn>user\nu2<end_of_turn>\n<start_of_turn>model\n",
    "qwen": "<|im_start|>system\n S <|im_end|>\n<|im_start|>user\nu1 <|im_end|>\n<|im_start|>assistant\n a1<|im_end|>\n<|im_start|>user\nu2<|im_end|>\n<|im_start|>assistant\n",
    "zephyr": "<|system|>\n S </s>\n<|user|>\nu1 </s>\n<|assistant|>\n a1</s>\n<|user|>\nu2</s>\n<|assistant|>\n",
    "llama2": "<s>[INST] <<SYS>>\nS\n<</SYS>>\n\nu1 [/INST] a1 </s><s>[INST] u2 [/INST]",
    "tulu": "<|system|>\n S \n<|user|>\nu1 \n<|assistant|>\n a1</s>\n<|user|>\nu2\n<|assistant|>\n",
    "mistral": "<s>[INST]  S \nu1  [/INST]  a1</s>[INST] u2 [/INST]",
    "yi": "<|im_start|>system\n S <|im_end|>\n<|im_start|>user\nu1 <|im_end|>\n<|im_start|>assistant\n a1<|im_end|>\n<|im_start|>user\nu2<|im_end|>\n<|im_start|>assistant\n",
    "vicuna": "S USER: u1 ASSISTANT: a1</s>USER: u2 ASSISTANT:",
}
SCHEMA = "family string, messages array<struct<role:string,content:string>>, _program string"


def rendered(spark, family, says, ask="assistant", own=()):
    rows = spark.createDataFrame([(family, says, "mine")], SCHEMA)
    return templates.prompts(rows, templates.programs(spark, own), ask=ask).first()


def test_every_family(spark):
    rows = spark.createDataFrame([(f, SAYS, "mine") for f in WANTED], SCHEMA)
    got = templates.prompts(rows, templates.programs(spark))
    assert got.columns == ["family", "messages", "_program", "prompt"]
    assert {r.family: r.prompt for r in got.collect()} == WANTED and len(templates.PROGRAMS) == 9


def test_defined_results(spark):
    assert rendered(spark, "yi", [("user", None)], None).prompt == "<|im_start|>user\n<|im_end|>\n"
    assert rendered(spark, "qwen", []).prompt == "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>assistant\n"
    assert rendered(spark, "gemma", [], None).prompt == "<bos>"
    assert rendered(spark, "gemma", None).prompt is None
    assert rendered(spark, "gemma", [("assistant", "x"), ("user", "y")], "user").prompt == "<bos><start_of_turn>model\nx<end_of_turn>\n<start_of_turn>user\ny<end_of_turn>\n<start_of_turn>user\n"
    assert rendered(spark, "llama2", [("system", "s")]).prompt == "<s>[INST] <<SYS>>\ns\n<</SYS>>\n\n [/INST]"
    assert rendered(spark, "yi", SAYS)._program == "mine"
    own = ("yi", "^", None, False, False, "s", ".", "u", ".", "a", ".", "u", "a")
    assert rendered(spark, "yi", SAYS, own=[own]).prompt == "^s S .uu1 .a a1.uu2.a"


def test_errors_name_what_is_wrong(spark):
    for family, says, wrong in (("none", SAYS, "no template for none"), (None, SAYS, "no template for null"), ("yi", [("tool", "x")], "role tool at 0"), ("yi", [("user", "x"), ("system", "y")], "role system at 1"), ("yi", [(None, "x")], "role null at 0")):
        with pytest.raises(Exception, match=wrong):
            rendered(spark, family, says)
    with pytest.raises(Exception, match="no template for none"):
        templates.prompts(spark.createDataFrame([("none", SAYS, "")], SCHEMA), templates.programs(spark)).select(F.count(F.lit(1))).collect()
    with pytest.raises(ValueError, match="nobody"):
        rendered(spark, "yi", SAYS, "tool")


def test_no_worker_and_no_shuffle(spark):
    rows = spark.createDataFrame([("yi", SAYS, "")], SCHEMA)
    plan = templates.prompts(rows, templates.programs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange hash" not in plan
