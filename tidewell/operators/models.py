"""Model stages as batch protocols: anything with generate; deterministic stubs for machines without models."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import BATCH_BYTES, asked, fresh


class Generator(Protocol):
    def generate(self, prompts: list[str], seeds: list[int]) -> list[str]: ...


class StubGenerator:
    """Text that depends on prompt and seed alone; verifies plumbing, not quality."""

    def generate(self, prompts: list[str], seeds: list[int]) -> list[str]:
        return [hashlib.sha1(f"{s}:{p}".encode()).hexdigest()[:12] for p, s in zip(prompts, seeds, strict=True)]


def generated(build: Callable[[], Generator], prompt: Column, key: Column, batch_bytes: int = BATCH_BYTES) -> Column:
    """Generated text, stripped; the engine is built once per task, samples are seeded by the row's key. A null prompt is read as the empty text."""

    def engine():
        e = build()
        return lambda prompts, seeds: [m.strip() for m in e.generate(prompts, seeds)]

    return asked(engine, "string", prompt, key, batch_bytes)


def generate(df: DataFrame, build: Callable[[], Generator], prompt: str | Column, key: str, out: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """df with a column of generated text; only prompts and keys leave the JVM, in batches of bounded bytes."""
    return df.withColumn(out, generated(build, F.col(prompt) if isinstance(prompt, str) else prompt, F.col(key), batch_bytes))


def instructions(spark, build: Callable[[], Generator], template: str, n: int, rounds: int) -> DataFrame:
    """rounds * n generated instructions; id = round * n + sample."""
    ids = spark.range(rounds * n).withColumn("pre_query_template", F.lit(template))
    return generate(ids, build, "pre_query_template", "id", "instruction")


def instructions_of(df: DataFrame, build: Callable[[], Generator], template: str, n: int, key: str, system: str = "system") -> DataFrame:
    """n instructions for each row of df, generated from the template with the row's own system prompt in the place of `{system}`: the row's key, round (from 0), id = key * n + round, which is the seed, and instruction. A null system prompt is the empty text."""
    before, mark, after = template.partition("{system}")
    if not mark:
        raise ValueError("the template has no {system}")
    at = fresh(df, "_prompt")
    asks = df.select(key, F.concat(F.lit(before), F.coalesce(system, F.lit("")), F.lit(after)).alias(at), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("round"))
    made = generate(asks.withColumn("id", F.col(key).cast("long") * n + F.col("round")), build, at, "id", "instruction")
    return made.drop(at)


def samples(df: DataFrame, build: Callable[[], Generator], n: int, prompt: str, key: str) -> DataFrame:
    """responses[]: n differently seeded samples per row."""
    each = df.select(key, prompt, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample")).withColumn("seed", F.col(key) * n + F.col("sample"))
    made = generate(each, build, prompt, "seed", "response")
    lists = made.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sample", "response"))).alias("s")).select(key, F.col("s.response").alias("responses"))
    return df.join(lists, key)


def turns(df: DataFrame, build: Callable[[], Generator], n: int, key: str, system: str | None = None, append: str = "", head: str = "<|{role}|>\n", tail: str = "<|end|>\n") -> DataFrame:
    """instruction_k and response_k for k = 2..n, each from the chat before it; the system prompt and the appended template stand only before a user's turn."""
    from .tagging import chat, render

    if n < 2:
        raise ValueError("at least two turns")
    said = [("user", F.col("instruction")), ("assistant", F.col("response"))]
    for k in range(2, n + 1):
        ask = F.concat(render(chat(*([("system", F.lit(system))] if system else []), *said), head, tail), F.lit(append))
        df = generate(df, build, ask, key, f"instruction_{k}")
        said.append(("user", F.col(f"instruction_{k}")))
        df = generate(df, build, render(chat(*said), head, tail, "assistant"), key, f"response_{k}")
        said.append(("assistant", F.col(f"response_{k}")))
    return df


#: Fixed value: the logit of a banned token.
BANNED = -9999.999


def ban_first(logits: Column, banned: list[int], first: Column) -> Column:
    """At the first position the banned tokens' logits are BANNED."""
    return F.when(first, F.transform(logits, lambda x, i: F.when(i.isin(banned), BANNED).otherwise(x))).otherwise(logits)


def flatten_first(logits: Column, first: Column, by: float = 1.2) -> Column:
    return F.when(first, F.transform(logits, lambda x: x / by)).otherwise(logits)


#: Frequent short words by language, for the stub detector.
COMMON = {"EN": ["the", "and", "of", "is"], "DE": ["der", "die", "und", "ist"], "FR": ["le", "la", "et", "des"], "ES": ["el", "los", "que", "y"]}


def language(text: Column) -> Column:
    """Upper-case code of the language whose frequent words occur most; null for empty texts or none found."""
    words = F.split(F.lower(text), r"[^\p{L}]+")
    frequent = {c: F.size(F.filter(words, lambda w: w.isin(COMMON[c]))) for c in COMMON}  # noqa: B023  used at once
    scored = F.array(*[F.struct(n.alias("n"), F.lit(c).alias("code")) for c, n in frequent.items()])
    best = F.array_max(scored)
    return F.when((text != "") & (best["n"] > 0), best["code"])
