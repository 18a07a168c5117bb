"""Model registry: a JSON object keyed by model path, read as a table; template choice; families."""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """model_name string, stop_tokens array<string>, stop_token_ids array<long>, stop_tokens_assistant array<string>,
pre_query_template string, pre_query_template_with_system_prompt string, mt_append_template string,
pre_query_template_math string, pre_query_template_code string, pre_query_template_translation string"""
#: Parts of a name, all needed, and the family of its chat template; the first that fits wins.
FAMILIES = [
    (("llama-3",), "llama3"),
    (("llama3",), "llama3"),
    (("gemma",), "gemma"),
    (("qwen",), "qwen"),
    (("zephyr",), "zephyr"),
    (("llama-2",), "llama2"),
    (("tulu",), "tulu"),
    (("mixtral",), "mistral"),
    (("mistral",), "mistral"),
    (("yi", "chat"), "yi"),
    (("vicuna",), "vicuna"),
]
#: Models that go by another name at the API.
API_NAMES = {f"meta-llama/Meta-Llama-3-{n}B-Instruct": f"meta-llama/Llama-3-{n}b-chat-hf" for n in (8, 70)}


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        entries = json.load(f)
    names = [x.split()[0] for x in SCHEMA.split(",")]
    return spark.createDataFrame([tuple([k, *(v.get(n) for n in names[1:])]) for k, v in entries.items()], SCHEMA)


def with_model(rows: DataFrame, registry: DataFrame, key: str = "model_name") -> DataFrame:
    """Rows with their model's entry (the registry is broadcast); a missing model fails whatever is selected of them."""
    marked = registry.withColumn("_known", F.lit(True))
    found = rows.join(F.broadcast(marked), key, "left")
    missing = F.raise_error(F.concat(F.lit("no such model: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
    return found.where(F.coalesce(F.col("_known"), missing)).drop("_known")


def template(control_task: str | None = None, system_prompt: bool = False) -> Column:
    """The control task's template, else the one with a system prompt, else the default; a model without the one asked for is an error."""
    name = f"pre_query_template_{control_task}" if control_task else "pre_query_template_with_system_prompt" if system_prompt else "pre_query_template"
    return F.coalesce(F.col(name), F.raise_error(F.lit(f"the model has no {name}")).cast("string"))


def stop_list(early_stopping: bool, multi_turn: bool = False) -> Column:
    """Stop tokens, then (but not for further turns) the assistant's markers, and with early stopping a line feed at the end."""
    none = F.array().cast("array<string>")
    parts = [F.coalesce("stop_tokens", none)] + ([] if multi_turn else [F.coalesce("stop_tokens_assistant", none)])
    return F.concat(*parts, F.array(F.lit("\n"))) if early_stopping else F.concat(*parts)


def family(model: Column) -> Column:
    low, out = F.lower(model), None
    for parts, name in FAMILIES:
        fits = functools.reduce(Column.__and__, [low.contains(p) for p in parts])
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise(F.raise_error(F.concat(F.lit("no template for "), model)).cast("string"))


def api_name(model: Column) -> Column:
    out = model
    for name, alias in API_NAMES.items():
        out = F.when(model == name, alias).otherwise(out)
    return out


def rounds(total: int, n: int) -> int:
    """Rounds of n samples; the last isn't clipped, so rounds * n rows may exceed total."""
    return -(-total // n)
