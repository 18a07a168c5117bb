"""Tagging, safety, reward, embedding and API stages; the models behind them are protocols with deterministic stubs.

Every stage adds columns to the row that it asks about, so nothing is joined back; only prompts
and keys go to Python, in batches of bounded bytes (see batches). Defined results: a null prompt reaches
a model as the empty text; an answer that can't be parsed leaves all columns of its mission
null, its generator among them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags, text
from .batches import asked, asked_each, fresh
from .models import Generator, generate


class Scorer(Protocol):
    def score(self, chats: list[str]) -> list[float]: ...


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]: ...


class Client(Protocol):
    def complete(self, messages: list[dict], params: dict) -> str | None: ...


class StubTagger:
    """A tagger's answer without its opening brace, some of them cut short; verifies plumbing, not quality."""

    def __init__(self, mission: str):
        self.mission = mission

    def generate(self, prompts: list[str], seeds: list[int]) -> list[str]:
        answers = {
            "difficulty": lambda s: f'"intent": "i{s}", "knowledge": null, "difficulty": "{tags.DIFFICULTY[s % 5]}"}} done',
            "quality": lambda s: f'"input_quality": "{tags.QUALITY[s % 5]}", "explanation": "e{s}"}}',
            "classification": lambda s: f'"primary_tag": "{[*tags.CATEGORY[:-1], "Others"][s % 12]}", "other_tags": ["Math", "t{s}"]}}',
        }
        return [answers[self.mission](s)[: -8 if s % 11 == 0 else None] for s in seeds]


class StubScorer:
    """Eight bits of the chat's digest, from -16 on in eighths; verifies plumbing, not quality."""

    def score(self, chats: list[str]) -> list[float]:
        return [hashlib.sha1(c.encode()).digest()[0] / 8 - 16 for c in chats]


class StubEncoder:
    """Bytes of the text's digest as a vector; verifies plumbing, not quality."""

    def encode(self, texts: list[str]) -> list[list[float]]:
        return [[b / 128 - 1 for b in hashlib.sha1(t.encode()).digest()[:8]] for t in texts]


class StubClient:
    """An API that gives nothing for every seventh length of a prompt; verifies plumbing, not quality."""

    def complete(self, messages: list[dict], params: dict) -> str | None:
        said = messages[-1]["content"]
        return None if len(said) % 7 == 0 else hashlib.sha1(f"{params['seed']}:{said}".encode()).hexdigest()[:12]


def chat(*turns: tuple[str, Column]) -> Column:
    """An array of (role, content)."""
    return F.array(*[F.struct(F.lit(who).alias("role"), said.alias("content")) for who, said in turns])


def render(messages: Column, head: str = "<|{role}|>\n", tail: str = "<|end|>\n", ask: str | None = None) -> Column:
    """The prompt of a chat: head, content and tail of each message, `{role}` standing for its role; with ask, the head of that role's next message."""
    before, _, after = head.partition("{role}")
    said = F.array_join(F.transform(messages, lambda m: F.concat(F.lit(before), m["role"], F.lit(after), m["content"], F.lit(tail))), "")
    return F.concat(said, F.lit(head.format(role=ask))) if ask else said


def tag(df: DataFrame, build: Callable[[], Generator], mission: str, generator: str, instruction: str = "instruction", key: str = "id") -> DataFrame:
    """The mission's columns and its generator's name, which is null where the answer couldn't be parsed."""
    prompt = F.concat(render(chat(("user", tags.prompt(mission, F.col(instruction)))), ask="assistant"), F.lit("{"))
    answer, at = fresh(df, "_answer"), fresh(df, "_tags")
    made = generate(df, build, prompt, key, answer).withColumn(at, tags.parse_tags(text.repair_tags(F.col(answer)), mission))
    name = {"difficulty": "difficulty_generator", "quality": "quality_generator", "classification": "task_category_generator"}[mission]
    columns = [_listed(F.col(at)[c]).alias(c) if c == "other_task_category" else F.col(at)[c].alias(c) for c in tags.MISSIONS[mission].values()]
    return made.select(*[F.col(f"`{c}`") for c in df.columns], *columns, F.when(F.col(at)["ok"], F.lit(generator)).alias(name))


def _listed(tags: Column) -> Column:
    """A JSON array's texts; any other value as the only one."""
    return F.when(tags.startswith("["), F.coalesce(F.from_json(tags, "array<string>"), F.array(tags))).when(tags.isNotNull(), F.array(tags))


def safety(df: DataFrame, build: Callable[[], Generator], key: str = "id") -> DataFrame:
    """llama_guard_2: the guard's raw answer, up to a closing brace if it holds one."""
    prompt = render(chat(("user", F.col("instruction")), ("assistant", F.col("response"))))
    made = generate(df, build, prompt, key, "llama_guard_2")
    return made.withColumn("llama_guard_2", text.strip(text.cut_at_stop(F.col("llama_guard_2"), ["}"])))


def reward(df: DataFrame, build: Callable[[], Scorer], model: str) -> DataFrame:
    """instruct_reward and reward_model."""
    prompt = render(chat(("user", F.col("instruction")), ("assistant", F.col("response"))))

    def scorer():
        s = build()
        return lambda chats, _: list(s.score(chats))

    return df.withColumn("instruct_reward", asked(scorer, "double", prompt)).withColumn("reward_model", F.lit(model))


def preference_rewards(df: DataFrame, build: Callable[[], Scorer], instruction: str = "instruction", responses: str = "responses", out: str = "rewards_armorm") -> DataFrame:
    """One struct(score) for each response of a row, in their order; the scorer sees whole batches of chats."""
    chats = F.transform(F.coalesce(responses, F.array().cast("array<string>")), lambda r: render(chat(("user", F.col(instruction)), ("assistant", r))))

    def scorer():
        s = build()
        return lambda chats, _: [{"score": float(x)} for x in s.score(chats)]

    return df.withColumn(out, asked_each(scorer, "struct<score:double>", chats))


def embed(df: DataFrame, build: Callable[[], Encoder], of: str = "instruction", out: str = "embedding") -> DataFrame:
    """A vector of each text."""

    def encoder():
        e = build()
        return lambda texts, _: list(e.encode(texts))

    return df.withColumn(out, asked(encoder, "array<float>", F.col(of)))


def api_responses(df: DataFrame, build: Callable[[], Client], prompt: str, params: dict, n: int = 1, threads: int = 8, out: str = "responses") -> DataFrame:
    """n answers of a chat API for each row, each by a request of its own, several at a time and no more rows in flight than threads; a request that gives none leaves the empty text, and `ok` says whether all gave one."""

    def client():
        c, pool = build(), ThreadPoolExecutor(threads)

        def ask(prompts: list[str], _: list) -> list[dict]:
            futures = [[pool.submit(c.complete, [{"role": "user", "content": p}], {**params, "seed": i}) for i in range(n)] for p in prompts]
            got = [[f.result() for f in row] for row in futures]
            return [{"responses": [x or "" for x in row], "ok": None not in row} for row in got]

        return ask

    at = fresh(df, "_got")
    made = df.withColumn(at, asked(client, "struct<responses:array<string>,ok:boolean>", F.col(prompt), rows=threads))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (out, "ok")]
    return made.select(*kept, F.col(at)["responses"].alias(out), F.col(at)["ok"].alias("ok"))


def instruction_rows(made: DataFrame, template: str, generator: str, temperature: float, top_p: float, seed: int, family: str | None = None, created: int = 0, ids: str = "id", said: str = "instruction") -> DataFrame:
    """Rows of the generation stage: stripped instruction (with a family also raw, sanitised and its class), empty response and the sampling settings."""
    raw = text.strip(F.col(said))
    clean = text.sanitize(raw, family) if family else F.struct(raw.alias("instruction"), F.lit(None).cast("double").alias("class"))
    config = F.struct(F.lit(float(temperature)).alias("temperature"), F.lit(float(top_p)).alias("top_p"), F.lit(generator).alias("input_generator"), F.lit(seed).cast("long").alias("seed"))
    rows = made.select(F.col(ids).cast("long").alias("id"), raw.alias("_raw"), clean.alias("_clean"))
    extra = [F.col("_raw").alias("raw_instruction"), F.col("_clean.class").alias("instruction_sanitize_class_num")] if family else []
    return rows.select("id", F.lit(template).alias("pre_query_template"), *extra[:1], F.col("_clean.instruction").alias("instruction"), *extra[1:], F.lit(None).cast("string").alias("response"), F.lit(created).cast("long").alias("created"), config.alias("gen_input_configs"))


def response_config(prompt: Column, generator: str, temperature: float, top_p: float, repetition_penalty: float, max_tokens: int, stop_tokens: list[str], engine: str) -> Column:
    """The settings a response was made with."""
    stops = F.array(*map(F.lit, stop_tokens)) if stop_tokens else F.array().cast("array<string>")
    return F.struct(prompt.alias("prompt"), F.lit(float(temperature)).alias("temperature"), F.lit(float(top_p)).alias("top_p"), F.lit(float(repetition_penalty)).alias("repetition_penalty"), F.lit(max_tokens).cast("long").alias("max_tokens"), stops.alias("stop_tokens"), F.lit(generator).alias("output_generator"), F.lit(engine).alias("engine"))


def check_arguments(model: str = "", sanitize: bool = False, total: int | None = None, repeat: int | None = None, turns: int = 2, logits_processor: bool = False, flaming_tokens: bool = False, api: bool = False, mission: str | None = None) -> None:
    """Settings that exclude each other, or that a stage can't do, are errors."""
    low = model.lower()
    if sanitize and "gemma" not in low and "llama-3" not in low:
        raise ValueError("only instructions of Gemma and Llama-3 models can be sanitised")
    if total is None and repeat is None:
        raise ValueError("give the number of prompts or of rounds")
    if turns < 2:
        raise ValueError("at least two turns")
    if logits_processor and flaming_tokens:
        raise ValueError("choose one of the two logits processors")
    if api and mission is not None and mission not in tags.MISSIONS:
        raise ValueError(f"mission {mission!r} can't be run by the API")


def job_name(model: str, n: int, top_p: float, temperature: float, created: int) -> str:
    """What a generation job is called: the model's last part, prompts, sampling settings and start."""
    return f"{model.rpartition('/')[2]}_topp{top_p:g}_temp{temperature:g}_{n}_{created}"
