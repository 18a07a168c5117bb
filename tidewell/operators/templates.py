"""Chat templates as data: a small program for each model family, joined to the rows by family and interpreted on the JVM.

A program says what stands at the start of a prompt, around the content of each role's message,
and where the next message begins. Where a family has no system role, the system message goes
into the first user's message instead, or makes one where there is none. Further programs, or other texts for a family, are rows of
the same shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .batches import fresh

PROGRAM = """family string, start string, default_system string, folds boolean, trims boolean,
system_head string, system_tail string, user_head string, user_tail string, assistant_head string, assistant_tail string, ask_user string, ask_assistant string"""
_IM = ("<|im_start|>system\n", "<|im_end|>\n", "<|im_start|>user\n", "<|im_end|>\n", "<|im_start|>assistant\n", "<|im_end|>\n", "<|im_start|>user\n", "<|im_start|>assistant\n")
#: The published prompt formats of the nine families. With folds, system_head and system_tail stand within the first user's message.
PROGRAMS = [
    ("llama3", "<|begin_of_text|>", None, False, True, "<|start_header_id|>system<|end_header_id|>\n\n", "<|eot_id|>", "<|start_header_id|>user<|end_header_id|>\n\n", "<|eot_id|>", "<|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>", "<|start_header_id|>user<|end_header_id|>\n\n", "<|start_header_id|>assistant<|end_header_id|>\n\n"),
    ("gemma", "<bos>", None, True, True, "", "\n\n", "<start_of_turn>user\n", "<end_of_turn>\n", "<start_of_turn>model\n", "<end_of_turn>\n", "<start_of_turn>user\n", "<start_of_turn>model\n"),
    ("qwen", "", "You are a helpful assistant.", False, False, *_IM),
    ("zephyr", "", None, False, False, "<|system|>\n", "</s>\n", "<|user|>\n", "</s>\n", "<|assistant|>\n", "</s>\n", "<|user|>\n", "<|assistant|>\n"),
    ("llama2", "", None, True, True, "<<SYS>>\n", "\n<</SYS>>\n\n", "<s>[INST] ", " [/INST]", " ", " </s>", "<s>[INST] ", ""),
    ("tulu", "", None, False, False, "<|system|>\n", "\n", "<|user|>\n", "\n", "<|assistant|>\n", "</s>\n", "<|user|>\n", "<|assistant|>\n"),
    ("mistral", "<s>", None, True, False, "", "\n", "[INST] ", " [/INST]", " ", "</s>", "[INST] ", ""),
    ("yi", "", None, False, False, *_IM),
    ("vicuna", "", "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions.", False, True, "", " ", "USER: ", " ", "ASSISTANT: ", "</s>", "USER:", "ASSISTANT:"),
]


def programs(spark: SparkSession, own: list[tuple] = ()) -> DataFrame:
    """The programs above with the caller's own; of the same family, the caller's counts."""
    mine = {p[0] for p in own}
    return spark.createDataFrame([*(p for p in PROGRAMS if p[0] not in mine), *own], PROGRAM)


def prompts(df: DataFrame, table: DataFrame, family: str = "family", messages: str = "messages", out: str = "prompt", ask: str | None = "assistant") -> DataFrame:
    """df with the prompt of each row's messages, an array of struct(role, content), by the row's family; ask opens the message of `user` or `assistant` at the end (None: neither).

    The programs (one small row a family) are broadcast. Defined results: null content is the empty
    text; no messages give the start (and the default system message) alone, null messages a null
    prompt; a system message that isn't the first, or a role other than system, user and assistant,
    is an error that names it, and so is a family without program, whatever is selected.
    """
    if ask not in (None, "user", "assistant"):
        raise ValueError(f"nobody to ask by the name of {ask!r}")
    at = fresh(df, "_program")
    one = table.select(F.col("family").alias(f"{at}_of"), F.struct(*[c for c in table.columns if c != "family"]).alias(at))
    found = df.join(F.broadcast(one), df[f"`{family}`"] == F.col(f"{at}_of"), "left")
    unknown = F.raise_error(F.concat(F.lit("no template for "), F.coalesce(F.col(f"`{family}`"), F.lit("null")))).cast("boolean")
    kept = found.where(F.when(F.col(at).isNotNull(), True).otherwise(unknown))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns if c != out], interpreted(F.col(f"`{messages}`"), F.col(at), ask).alias(out))


def interpreted(messages: Column, p: Column, ask: str | None) -> Column:
    """What a program makes of messages. Every message gives one piece, so the work is linear in the text, and the pieces are joined once."""
    body = lambda m: F.coalesce(m["content"], F.lit(""))
    said = lambda m: F.when(p["trims"], text.strip(body(m))).otherwise(body(m))
    first = F.get(messages, F.lit(0))
    given = F.coalesce(first["role"] == "system", F.lit(False))
    system = F.when(given, said(first)).otherwise(p["default_system"])
    framed = F.coalesce(F.concat(p["system_head"], system, p["system_tail"]), F.lit(""))
    first_user = F.coalesce(F.array_position(F.transform(messages, lambda m: F.coalesce(m["role"] == "user", F.lit(False))), True), F.lit(0))

    def piece(m: Column, i: Column) -> Column:
        folded = F.when(p["folds"] & (i + 1 == first_user), framed).otherwise("")
        bad = F.raise_error(F.concat(F.lit("no place for a message of role "), F.coalesce(m["role"], F.lit("null")), F.lit(" at "), i.cast("string")))
        return (
            F.when(m["role"] == "user", F.concat(p["user_head"], folded, said(m), p["user_tail"]))
            .when(m["role"] == "assistant", F.concat(p["assistant_head"], said(m), p["assistant_tail"]))
            .when((m["role"] == "system") & (i == 0), "")
            .otherwise(bad.cast("string"))
        )

    alone = F.when(given & (first_user == 0), F.concat(p["user_head"], framed, p["user_tail"])).otherwise("")
    opened = F.concat(p["start"], F.when(p["folds"], alone).otherwise(framed))
    parts = F.concat(F.array(opened), F.transform(messages, piece), F.array(p[f"ask_{ask}"]) if ask else F.array().cast("array<string>"))
    return F.array_join(parts, "")
