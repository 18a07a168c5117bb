"""Driver queries of the model stages, sources and sinks, by name, and their SQL.

Models are stubs that SQL can restate: a generator says the first twelve digits of the SHA-1 of
seed:prompt, a scorer maps the first byte of a chat's SHA-1, a tagger answers by the row's key.
They are fixtures, not judgements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tags, text
from ..operators import curate, models, neighbours, positions, preference, tagging, templates
from ..sources import datasets, schemas, shared
from ..sources import models as registry
from ..streaming import stages
from .registry import _KNN, _docs, _made_sql, _sanitized_sql, _strip_sql, query


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return shared.new_folder(spark)


def _said(role: str, body: str) -> str:
    return f"'<|{role}|>' || chr(10) || {body} || '<|end|>' || chr(10)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("instruction"), F.col("source").alias("response"))


_CHAT = f"{_said('user', 'text')} || {_said('assistant', 'source')}"


@query("c16_render", f"SELECT doc_id, {_said('system', "'be brief'")} || {_CHAT} || '<|user|>' || chr(10) AS prompt FROM documents")
def c16_render(spark, sf_dir):
    turns = tagging.chat(("system", F.lit("be brief")), ("user", F.col("text")), ("assistant", F.col("source")))
    return _docs(spark, sf_dir).select("doc_id", tagging.render(turns, ask="user").alias("prompt"))


_LIST = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
_PICK = lambda values, by: f"{_LIST(values)}[CAST({by} AS INT) + 1]"
_OK = "doc_id % 11 <> 0"


@query("m7_difficulty", f"SELECT doc_id, CASE WHEN {_OK} THEN 'i' || doc_id END AS intent, CAST(NULL AS VARCHAR) AS knowledge, CASE WHEN {_OK} THEN {_PICK(tags.DIFFICULTY, 'doc_id % 5')} END AS difficulty, CASE WHEN {_OK} THEN 'tagger' END AS difficulty_generator FROM documents")
def m7_difficulty(spark, sf_dir):
    return tagging.tag(_docs(spark, sf_dir).select("doc_id", "text"), lambda: tagging.StubTagger("difficulty"), "difficulty", "tagger", "text", "doc_id").drop("text")


@query("m7_quality", f"SELECT doc_id, CASE WHEN {_OK} THEN {_PICK(tags.QUALITY, 'doc_id % 5')} END AS input_quality, CASE WHEN {_OK} THEN 'e' || doc_id END AS quality_explanation, CASE WHEN {_OK} THEN 'tagger' END AS quality_generator FROM documents")
def m7_quality(spark, sf_dir):
    return tagging.tag(_docs(spark, sf_dir).select("doc_id", "text"), lambda: tagging.StubTagger("quality"), "quality", "tagger", "text", "doc_id").drop("text")


_CATEGORIES = [*tags.CATEGORY[:-1], "Others"]


@query("m7_classification", f"SELECT doc_id, CASE WHEN {_OK} THEN {_PICK(_CATEGORIES, 'doc_id % 12')} END AS task_category, CASE WHEN {_OK} THEN 'Math|t' || doc_id END AS others, CASE WHEN {_OK} THEN 'tagger' END AS task_category_generator FROM documents")
def m7_classification(spark, sf_dir):
    out = tagging.tag(_docs(spark, sf_dir).select("doc_id", "text"), lambda: tagging.StubTagger("classification"), "classification", "tagger", "text", "doc_id")
    return out.select("doc_id", "task_category", F.array_join("other_task_category", "|").alias("others"), "task_category_generator")


@query("m8_safety", f"SELECT doc_id, {_made_sql('doc_id', _CHAT)} AS llama_guard_2 FROM documents")
def m8_safety(spark, sf_dir):
    return tagging.safety(_pairs(spark, sf_dir), models.StubGenerator).select(F.col("id").alias("doc_id"), "llama_guard_2")


def _score_sql(chat: str) -> str:
    return f"CAST(('0x' || substr(sha1({chat}), 1, 2))::INT AS DOUBLE) / 8 - 16"


@query("m9_reward", f"SELECT doc_id, {_score_sql(_CHAT)} AS instruct_reward, 'rm' AS reward_model FROM documents")
def m9_reward(spark, sf_dir):
    return tagging.reward(_pairs(spark, sf_dir), tagging.StubScorer, "rm").select(F.col("id").alias("doc_id"), "instruct_reward", "reward_model")


_TWO = f"(SELECT *, {_score_sql(_CHAT)} AS one, {_score_sql(_said('user', 'text') + ' || ' + _said('assistant', 'lang'))} AS two FROM documents)"


@query("m10_preference", f"SELECT doc_id, one, two, CASE WHEN two > one THEN lang ELSE source END AS chosen, CASE WHEN two < one THEN lang ELSE source END AS rejected FROM {_TWO}")
def m10_preference(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.col("text").alias("instruction"), F.array("source", "lang").alias("responses"))
    scored = tagging.preference_rewards(rows, tagging.StubScorer).withColumn("rewards", F.col("rewards_armorm.score"))
    return preference.pairs(scored).selectExpr("doc_id", "rewards[0] as one", "rewards[1] as two", "chosen[1].content as chosen", "rejected[1].content as rejected")


_BYTE = lambda i: f"CAST(('0x' || substr(sha1(text), {2 * i + 1}, 2))::INT AS DOUBLE) / 128 - 1"


@query("m12_embed", f"SELECT doc_id, CAST(8 AS INT) AS dim, {_BYTE(0)} AS first, {_BYTE(7)} AS last FROM documents")
def m12_embed(spark, sf_dir):
    out = tagging.embed(_docs(spark, sf_dir).select("doc_id", "text"), tagging.StubEncoder, "text")
    return out.selectExpr("doc_id", "size(embedding) as dim", "cast(embedding[0] as double) as first", "cast(embedding[7] as double) as last")


@query("m3_api_responses", f"SELECT doc_id, CASE WHEN length(text) % 7 = 0 THEN '' ELSE {_made_sql('0', 'text')} END AS response, length(text) % 7 <> 0 AS ok FROM documents")
def m3_api_responses(spark, sf_dir):
    return tagging.api_responses(_docs(spark, sf_dir).select("doc_id", "text"), tagging.StubClient, "text", {}).selectExpr("doc_id", "responses[0] as response", "ok")


@query("m6_api_samples", f"SELECT doc_id, CASE WHEN length(text) % 7 = 0 THEN '||' ELSE {_made_sql('0', 'text')} || '|' || {_made_sql('1', 'text')} || '|' || {_made_sql('2', 'text')} END AS responses FROM documents")
def m6_api_samples(spark, sf_dir):
    out = tagging.api_responses(_docs(spark, sf_dir).select("doc_id", "text"), tagging.StubClient, "text", {}, 3)
    return out.select("doc_id", F.array_join("responses", "|").alias("responses"))


@query("m5_samples_joined", f"SELECT doc_id, {" || '|' || ".join(_made_sql(f'doc_id * 4 + {i}', 'text') for i in range(4))} AS responses FROM documents")
def m5_samples_joined(spark, sf_dir):
    made = models.samples(_docs(spark, sf_dir).select("doc_id", "text"), models.StubGenerator, 4, "text", "doc_id")
    return made.select("doc_id", F.array_join("responses", "|").alias("responses"))


_ASSISTANT = "'<|assistant|>' || chr(10)"
_MT = f"""WITH a AS (SELECT doc_id, {_CHAT} AS said FROM documents),
b AS (SELECT *, {_made_sql('doc_id', _said('system', "'go on'") + " || said || '<u>'")} AS instruction_2 FROM a),
c AS (SELECT *, said || {_said('user', 'instruction_2')} AS asked FROM b),
d AS (SELECT *, {_made_sql('doc_id', f'asked || {_ASSISTANT}')} AS response_2 FROM c),
e AS (SELECT *, asked || {_said('assistant', 'response_2')} AS said2 FROM d),
f AS (SELECT *, {_made_sql('doc_id', _said('system', "'go on'") + " || said2 || '<u>'")} AS instruction_3 FROM e),
g AS (SELECT *, {_made_sql('doc_id', f"said2 || {_said('user', 'instruction_3')} || {_ASSISTANT}")} AS response_3 FROM f)
SELECT doc_id, instruction_2, response_2, instruction_3, response_3 FROM g"""


@query("m4_turns", _MT)
def m4_turns(spark, sf_dir):
    out = models.turns(_pairs(spark, sf_dir), models.StubGenerator, 3, "id", "go on", "<u>")
    return out.select(F.col("id").alias("doc_id"), "instruction_2", "response_2", "instruction_3", "response_3")


_NAMES = ["org/Llama-3-8B", "org/Llama3-8B", "google/gemma-2-9b", "Qwen2-7B", "zephyr-7b", "Llama-2-7b", "tulu-2", "Mixtral-8x7B", "Mistral-7B", "Yi-34B-Chat", "vicuna-7b"]
_KINDS = ["llama3", "llama3", "gemma", "qwen", "zephyr", "llama2", "tulu", "mistral", "mistral", "yi", "vicuna"]


@query("c15_family", f"SELECT doc_id, {_PICK(_KINDS, 'doc_id % 11')} AS family FROM documents")
def c15_family(spark, sf_dir):
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % len(_NAMES)).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", registry.family(name).alias("family"))


#: For the SQL: what each family's prompt starts with, its messages ({} is the content) and the opening of the answer; f: the system message of those that fold it.
_PATTERNS = """t(family, start, plain, s, f, u, a, ask, trims) AS (VALUES
('llama3', '<|begin_of_text|>', '', '<|start_header_id|>system<|end_header_id|>~~{}<|eot_id|>', '', '<|start_header_id|>user<|end_header_id|>~~{}<|eot_id|>', '<|start_header_id|>assistant<|end_header_id|>~~{}<|eot_id|>', '<|start_header_id|>assistant<|end_header_id|>~~', true),
('gemma', '<bos>', '', '', '{}~~', '<start_of_turn>user~{}<end_of_turn>~', '<start_of_turn>model~{}<end_of_turn>~', '<start_of_turn>model~', true),
('qwen', '', '<|im_start|>system~You are a helpful assistant.<|im_end|>~', '<|im_start|>system~{}<|im_end|>~', '', '<|im_start|>user~{}<|im_end|>~', '<|im_start|>assistant~{}<|im_end|>~', '<|im_start|>assistant~', false),
('zephyr', '', '', '<|system|>~{}</s>~', '', '<|user|>~{}</s>~', '<|assistant|>~{}</s>~', '<|assistant|>~', false),
('llama2', '', '', '', '<<SYS>>~{}~<</SYS>>~~', '<s>[INST] {} [/INST]', ' {} </s>', '', true),
('tulu', '', '', '<|system|>~{}~', '', '<|user|>~{}~', '<|assistant|>~{}</s>~', '<|assistant|>~', false),
('mistral', '<s>', '', '', '{}~', '[INST] {} [/INST]', ' {}</s>', '', false),
('yi', '', '', '<|im_start|>system~{}<|im_end|>~', '', '<|im_start|>user~{}<|im_end|>~', '<|im_start|>assistant~{}<|im_end|>~', '<|im_start|>assistant~', false),
('vicuna', '', 'A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user''s questions. ', '{} ', '', 'USER: {} ', 'ASSISTANT: {}</s>', 'ASSISTANT:', true))"""
_PUT = lambda pattern, said: f"replace(replace({pattern}, '~', chr(10)), '{{}}', {said})"
_TEMPLATES = f"""WITH {_PATTERNS},
m AS (SELECT conv_id, turn, role, family, start, plain, s, f, u, a, ask, CASE WHEN trims THEN {_strip_sql("coalesce(text, '')")} ELSE coalesce(text, '') END AS said FROM (SELECT *, {_PICK(_KINDS, 'conv_id % 11')} AS family FROM conversations WHERE role IN ('system', 'user', 'assistant')) JOIN t USING (family)),
n AS (SELECT *, max(CASE WHEN role = 'system' THEN {_PUT('f', 'said')} END) OVER (PARTITION BY conv_id) AS folded, role = 'user' AND row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1 AS opens FROM m)
SELECT conv_id, family, replace(any_value(start) || CASE WHEN bool_or(role = 'system') THEN '' ELSE any_value(plain) END, '~', chr(10))
  || string_agg(CASE role WHEN 'system' THEN {_PUT('s', 'said')} WHEN 'user' THEN {_PUT('u', "CASE WHEN opens THEN coalesce(folded, '') ELSE '' END || said")} ELSE {_PUT('a', 'said')} END, '' ORDER BY turn) || replace(any_value(ask), '~', chr(10)) AS prompt
FROM n GROUP BY conv_id, family"""


@query("c16_templates", _TEMPLATES)
def c16_templates(spark, sf_dir):
    """Whole conversations in the template of a model's family, the next answer opened."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role in ('system', 'user', 'assistant')")
    said = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("conv_id") % len(_NAMES)).cast("int"))
    return templates.prompts(said.withColumn("family", registry.family(name)), templates.programs(spark)).select("conv_id", "family", "prompt")


@query("c17_api_name", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'meta-llama/Llama-3-8b-chat-hf' WHEN 1 THEN 'meta-llama/Llama-3-70b-chat-hf' ELSE source END AS name FROM documents")
def c17_api_name(spark, sf_dir):
    name = F.when(F.col("doc_id") % 3 == 0, "meta-llama/Meta-Llama-3-8B-Instruct").when(F.col("doc_id") % 3 == 1, "meta-llama/Meta-Llama-3-70B-Instruct").otherwise(F.col("source"))
    return _docs(spark, sf_dir).select("doc_id", registry.api_name(name).alias("name"))


def _holds(words):
    return "(" + " OR ".join("contains(t, lower('" + w.replace("'", "''") + "'))" for w in words) + ")"


@query("c20_keywords", f"SELECT doc_id, {_holds(text.MATH_KEYWORDS)} AS math, {_holds(text.CODE_KEYWORDS)} AS code FROM (SELECT doc_id, lower(text || CASE doc_id % 5 WHEN 0 THEN ' ANOVA' WHEN 1 THEN ' c++' ELSE '' END) AS t FROM documents)")
def c20_keywords(spark, sf_dir):
    t = F.concat("text", F.when(F.col("doc_id") % 5 == 0, " ANOVA").when(F.col("doc_id") % 5 == 1, " c++").otherwise(""))
    return _docs(spark, sf_dir).select("doc_id", text.has_keyword(t, text.MATH_KEYWORDS).alias("math"), text.has_keyword(t, text.CODE_KEYWORDS).alias("code"))


_MCQ = r"(?i)\([A-D]\)|[A-D][.)]|[a-d][.)]"


@query("c3_mcq_end", f"SELECT doc_id, many AS is_mcq, CASE WHEN many THEN length(t) - length(list_last(string_split_regex(t, '{_MCQ}'))) ELSE -1 END AS \"end\" FROM (SELECT *, len(regexp_extract_all(t, '{_MCQ}')) >= 4 AS many FROM (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN ' A) x B) y C) z D) w' ELSE ' (a) x' END AS t FROM documents))")
def c3_mcq_end(spark, sf_dir):
    t = F.concat("text", F.when(F.col("doc_id") % 2 == 0, " A) x B) y C) z D) w").otherwise(" (a) x"))
    return _docs(spark, sf_dir).select("doc_id", text.mcq_end(t).alias("m")).select("doc_id", "m.is_mcq", F.col("m.end").cast("long").alias("end"))


@query("c9_demo_clean", "SELECT doc_id, split_part(text, chr(10), 1) AS line FROM documents")
def c9_demo_clean(spark, sf_dir):
    template = F.concat(F.lit("<|user|>"), "source")
    return _docs(spark, sf_dir).select("doc_id", text.demo_clean(F.concat(template, "text"), template).alias("line"))


@query("m13_ban_first", "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN -9999.999 ELSE CAST(embedding[3] AS DOUBLE) END AS banned, CAST(embedding[1] AS DOUBLE) AS other FROM embeddings")
def m13_ban_first(spark, sf_dir):
    logits = models.ban_first(F.col("embedding").cast("array<double>"), [2, 5], F.col("vec_id") % 2 == 0)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", logits.alias("x")).selectExpr("vec_id", "x[2] as banned", "x[0] as other")


@query("m14_flatten_first", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / CASE WHEN vec_id % 2 = 0 THEN 1.2 ELSE 1 END, 6) AS logit FROM embeddings")
def m14_flatten_first(spark, sf_dir):
    logits = models.flatten_first(F.col("embedding").cast("array<double>"), F.col("vec_id") % 2 == 0)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.round(F.get(logits, F.lit(0)), 6).alias("logit"))


def _registry(spark: SparkSession) -> DataFrame:
    rows = [("org/a", ["<e>"], [1], ["<a>"], "A", "SA", None, "MA", None, None), ("org/b", ["<x>", "<y>"], [2], [], "B", "SB", "T", "MB", None, None)]
    return spark.createDataFrame(rows, registry.SCHEMA)


@query("s5_registry", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS plain, CASE WHEN doc_id % 2 = 0 THEN 'MA' ELSE 'MB' END AS math, CASE WHEN doc_id % 2 = 0 THEN 'SA' ELSE 'SB' END AS system, CASE WHEN doc_id % 2 = 0 THEN '<e>|<a>|' ELSE '<x>|<y>|' END || chr(10) AS stops, CASE WHEN doc_id % 2 = 0 THEN '<e>' ELSE '<x>|<y>' END AS turn_stops FROM documents")
def s5_registry(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, "org/a").otherwise("org/b").alias("model_name"))
    found = registry.with_model(rows, _registry(spark))
    return found.select("doc_id", registry.template().alias("plain"), registry.template("math").alias("math"), registry.template(system_prompt=True).alias("system"), F.array_join(registry.stop_list(True), "|").alias("stops"), F.array_join(registry.stop_list(False, True), "|").alias("turn_stops"))


@query("s2_jsonl", "SELECT doc_id, text, lang FROM documents")
def s2_jsonl(spark, sf_dir):
    rows, path = _docs(spark, sf_dir).select("doc_id", "text", "lang"), f"{_folder(spark)}.jsonl"
    datasets.write_jsonl(rows, path)
    return datasets.read_dataset(spark, path, rows.schema)


_SHARD = "CASE WHEN lang = 'en' THEN 0 ELSE 1 END"


@query("s12_shards", f"SELECT {_SHARD} AS file_idx, doc_id, text FROM documents")
def s12_shards(spark, sf_dir):
    rows, folder = _docs(spark, sf_dir).select("doc_id", "text", "lang"), _folder(spark)
    paths = [f"{folder}/{i}.jsonl" for i in (0, 1)]
    for path, part in zip(paths, (rows.where("lang = 'en'"), rows.where("lang is distinct from 'en'")), strict=True):
        datasets.write_jsonl(part, path)
    return datasets.read_shards(spark, paths, rows.schema).select("file_idx", "doc_id", "text")


_IN = "CAST(doc_id % 4 AS INT)"


@query("s4_stages", f"""SELECT doc_id AS id, {_IN} AS file_idx, text AS instruction, CASE WHEN {_IN} > 0 THEN source END AS response, CASE WHEN {_IN} > 0 THEN 'e' END AS engine, CASE WHEN {_IN} > 1 THEN text END AS prompt,
  CASE WHEN {_IN} = 2 THEN {_PICK(tags.DIFFICULTY, 'doc_id % 5')} END AS difficulty, CASE WHEN {_IN} = 2 THEN CAST(doc_id AS DOUBLE) WHEN {_IN} = 3 THEN doc_id + 0.5::DOUBLE END AS instruct_reward, CASE WHEN {_IN} = 3 THEN lang END AS language FROM documents""")
def s4_stages(spark, sf_dir):
    """Shards of four stages, with inferred schemas that disagree on what is null, whole or nested, read together."""
    rows, folder = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("instruction"), "source", "lang"), _folder(spark)
    null, settings = F.lit(None), F.struct(F.lit("e").alias("engine"), F.lit(1).alias("temperature"))
    tag = F.get(F.array(*map(F.lit, tags.DIFFICULTY)), (F.col("id") % 5).cast("int"))
    answered = {"response": F.col("source"), "gen_response_configs": F.struct(F.col("instruction").alias("prompt"), *[settings[c].alias(c) for c in ("engine", "temperature")])}
    stages_of = [
        {"response": null.cast("string"), "gen_response_configs": null.cast("string")},
        {"response": F.col("source"), "gen_response_configs": settings},
        answered | {"difficulty": tag, "instruct_reward": F.col("id")},
        answered | {"instruct_reward": F.col("id") + 0.5, "language": F.col("lang")},
    ]
    paths = [f"{folder}/{i}.jsonl" for i in range(4)]
    for i, (path, more) in enumerate(zip(paths, stages_of, strict=True)):
        datasets.write_jsonl(rows.where(F.col("id") % 4 == i).withColumns(more).drop("source", "lang"), path)
    found = schemas.read_stages(spark, paths)
    return found.select("id", "file_idx", "instruction", "response", "gen_response_configs.engine", "gen_response_configs.prompt", "difficulty", "instruct_reward", "language")


@query("s12_row_index", f"SELECT doc_id, {_SHARD} AS file_idx, row_number() OVER (PARTITION BY {_SHARD} ORDER BY doc_id) - 1 AS id, row_number() OVER (ORDER BY {_SHARD}, doc_id) - 1 AS row_idx FROM documents")
def s12_row_index(spark, sf_dir):
    """Dense positions of rows read from files, in the files' order."""
    rows, folder = _docs(spark, sf_dir).select("doc_id", "text", "lang"), _folder(spark)
    paths = [f"{folder}/{i}.jsonl" for i in (0, 1)]
    for path, part in zip(paths, (rows.where("lang = 'en'"), rows.where("lang is distinct from 'en'")), strict=True):
        datasets.write_jsonl(part.orderBy("doc_id"), path)
    return positions.read_numbered(spark, paths, rows.schema).select("doc_id", "file_idx", "id", "row_idx")


@query("k7_concatenated", "SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 0")
def k7_concatenated(spark, sf_dir):
    rows, folder = _docs(spark, sf_dir).select("doc_id", "lang"), _folder(spark)
    datasets.write_jsonl(rows, f"{folder}/0.jsonl")
    datasets.write_jsonl(rows.where("doc_id % 2 = 0"), f"{folder}/1.jsonl")
    return datasets.concatenate(spark, [f"{folder}/0.jsonl", f"{folder}/1.jsonl"], f"{folder}/all.jsonl", rows.schema)


@query("k6_index", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(len(embedding) AS INT) AS dim FROM embeddings")
def k6_index(spark, sf_dir):
    path = _folder(spark)
    neighbours.save_index(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), path)
    return neighbours.load_index(spark, path).selectExpr("vec_id", "cast(embedding[0] as double) as first", "size(embedding) as dim")


@query("k6_index_search", _KNN + " SELECT vec_id, nid, rk, round(d, 4) AS d FROM r WHERE rk <= 10 AND vec_id % 20 = 0")
def k6_index_search(spark, sf_dir):
    """An index of one half, the other half appended; every twentieth vector is looked up in it."""
    rows, path = spark.read.parquet(f"{sf_dir}/embeddings.parquet"), _folder(spark)
    neighbours.save_index(rows.where("vec_id % 2 = 0"), path)
    neighbours.append_index(rows.where("vec_id % 2 = 1"), path)
    found = neighbours.search_index(rows.where("vec_id % 20 = 0"), path, 10)
    return found.select(F.col("id").alias("vec_id"), "nid", F.col("rank").cast("long").alias("rk"), F.round("d", 4).alias("d"))


@query("k3_staged", "SELECT doc_id, length(text) AS size FROM documents")
def k3_staged(spark, sf_dir):
    """A stage that stops half-way, starts again, and is removed once its output is written."""
    rows, folder = _docs(spark, sf_dir).select("doc_id", "text"), _folder(spark)
    sized = lambda d: d.select("doc_id", F.length("text").cast("long").alias("size"))
    stages.run_stage(rows.where("doc_id % 2 = 0"), sized, f"{folder}/stage", "doc_id")
    stages.run_stage(rows, sized, f"{folder}/stage", "doc_id", 2).write.parquet(f"{folder}/out")
    stages.finish(spark, f"{folder}/stage")
    return spark.read.parquet(f"{folder}/out")


@query("k3_streamed", "SELECT doc_id, length(text) AS size FROM documents")
def k3_streamed(spark, sf_dir):
    """Exactly-once micro-batches over a folder of files."""
    folder = _folder(spark)
    _docs(spark, sf_dir).select("doc_id", "text").repartition(6, "doc_id").write.parquet(f"{folder}/in")
    sized = lambda d: d.select("doc_id", F.length("text").cast("long").alias("size"))
    return stages.stream_stage(spark, f"{folder}/in", "doc_id long, text string", sized, f"{folder}/out", f"{folder}/log", files=2)


@query("o5_round_order", "SELECT doc_id, CAST(doc_id // 100 AS BIGINT) AS round, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY sha1('42:' || doc_id), doc_id) AS place FROM documents")
def o5_round_order(spark, sf_dir):
    return curate.round_order(_docs(spark, sf_dir).select("doc_id"), "doc_id", 100)


_U2 = _KNN + """, g AS (SELECT vec_id, round(min(d) FILTER (nid <> vec_id), 4) AS min_neighbor_distance, count(*) FILTER (nid <> vec_id AND d < 1.2) AS repeat_count, min(nid) FILTER (nid <> vec_id AND d < 1.2) AS low FROM r WHERE rk <= 500 GROUP BY vec_id)
SELECT g.vec_id, 'c' || g.vec_id AS conversation_id, e.label, min_neighbor_distance, repeat_count, 'c' || least(low, g.vec_id * CASE WHEN low IS NOT NULL THEN 1 END) AS min_similar_conversation_id FROM g JOIN embeddings e ON e.vec_id = g.vec_id"""


def _attached(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("conversation_id", F.concat(F.lit("c"), F.col("vec_id").cast("string")))
    found = neighbours.near_duplicate_rows(rows, 1.2, 500, "vec_id")
    return found.select("vec_id", "conversation_id", "label", F.round("min_neighbor_distance", 4).alias("min_neighbor_distance"), "repeat_count", "min_similar_conversation_id")


@query("j3_attached", _U2)
def j3_attached(spark, sf_dir):
    return _attached(spark, sf_dir)


@query("u2_deduplicated", f"SELECT * FROM ({_U2}) WHERE min_similar_conversation_id IS NULL OR min_similar_conversation_id = conversation_id")
def u2_deduplicated(spark, sf_dir):
    return neighbours.deduplicated(_attached(spark, sf_dir))


_RAW = f"(SELECT doc_id, {_strip_sql('text')} AS t FROM documents)"


@query("r1_instruction_rows", f"SELECT c.doc_id AS id, '<user>' AS pre_query_template, t AS raw_instruction, instruction, class, CAST(NULL AS VARCHAR) AS response, CAST(5 AS BIGINT) AS created, CAST(0.5 AS DOUBLE) AS temperature, CAST(1.0 AS DOUBLE) AS top_p, 'org/a' AS input_generator, CAST(7 AS BIGINT) AS seed FROM ({_sanitized_sql(False, _RAW)}) c JOIN {_RAW} w ON w.doc_id = c.doc_id")
def r1_instruction_rows(spark, sf_dir):
    """Documents as raw output of a generator: whole texts are stripped, sanitised and classed."""
    rows = tagging.instruction_rows(_docs(spark, sf_dir), "<user>", "org/a", 0.5, 1.0, 7, "gemma-2", 5, "doc_id", "text")
    return rows.select("id", "pre_query_template", "raw_instruction", "instruction", F.col("instruction_sanitize_class_num").alias("class"), "response", "created", "gen_input_configs.*")


@query("r2_response_configs", f"SELECT doc_id, {_made_sql('doc_id', 'text')} AS response, text AS prompt, CAST(0.7 AS DOUBLE) AS temperature, CAST(0.9 AS DOUBLE) AS top_p, CAST(1.1 AS DOUBLE) AS repetition_penalty, CAST(64 AS BIGINT) AS max_tokens, '<e>|<f>' AS stop_tokens, 'org/a' AS output_generator, 'stub' AS engine FROM documents")
def r2_response_configs(spark, sf_dir):
    """Responses with the settings they were made with, the whole prompt among them."""
    rows = models.generate(_docs(spark, sf_dir).select("doc_id", "text"), models.StubGenerator, "text", "doc_id", "response")
    config = tagging.response_config(F.col("text"), "org/a", 0.7, 0.9, 1.1, 64, ["<e>", "<f>"], "stub")
    rows = rows.withColumn("gen_response_configs", config).select("doc_id", "response", "gen_response_configs.*")
    return rows.withColumn("stop_tokens", F.array_join("stop_tokens", "|"))


def _sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From documents as instructions to conversation rows, through all stages, over four shards."""
    rows = tagging.instruction_rows(_docs(spark, sf_dir), "<user>", "org/model-a", 1.0, 1.0, 1, ids="doc_id", said="text")
    rows = models.generate(rows.drop("response"), models.StubGenerator, "instruction", "id", "response")
    rows = rows.withColumn("gen_response_configs", tagging.response_config(F.col("instruction"), "org/model-a", 0.0, 1.0, 1.0, 64, ["<e>"], "stub"))
    for mission in tags.MISSIONS:
        rows = tagging.tag(rows, lambda m=mission: tagging.StubTagger(m), mission, "tagger")
    rows = tagging.reward(tagging.safety(rows, models.StubGenerator), tagging.StubScorer, "rm")
    rows = rows.withColumn("language", models.language(F.col("instruction"))).withColumnRenamed("id", "doc_id")
    return curate.to_conversations(positions.numbered(rows.withColumn("file_idx", F.col("doc_id") % 4), "doc_id", "file_idx"), "model-a")


_R = _made_sql("id", "i")
_TURNS = f"{_said('user', 'i')} || {_said('assistant', 'r')}"
_KEPT = "id % 11 <> 0"
_WORDS = "string_split_regex(lower(i), '[^\\p{L}]+')"
_FOUND = ", ".join(f"4 * len(list_filter({_WORDS}, lambda w: w IN ({', '.join(map(repr, models.COMMON[c]))}))) + {n}" for n, c in enumerate(sorted(models.COMMON)))
_CODE = f"{sorted(models.COMMON)!r}[CAST(f % 4 AS INT) + 1]"
_SFT = f"""WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id % 4, doc_id) - 1 AS place, {_strip_sql('text')} AS i FROM documents), b AS (SELECT *, {_R} AS r, greatest({_FOUND}) AS f FROM a)
SELECT 'model-a_' || place AS conversation_id, i AS instruction, r AS response, 'human:' || i || '|gpt:' || r AS conversations, '1.0|1.0|org/model-a|1|<user>' AS gen_input_configs,
  CASE WHEN {_KEPT} THEN 'i' || id END AS intent, CAST(NULL AS VARCHAR) AS knowledge, CASE WHEN {_KEPT} THEN {_PICK(tags.DIFFICULTY, 'id % 5')} END AS difficulty, CASE WHEN {_KEPT} THEN 'tagger' END AS difficulty_generator,
  CASE WHEN {_KEPT} THEN {_PICK(tags.QUALITY, 'id % 5')} END AS input_quality, CASE WHEN {_KEPT} THEN 'e' || id END AS quality_explanation, CASE WHEN {_KEPT} THEN 'tagger' END AS quality_generator,
  CASE WHEN {_KEPT} AND id % 12 <> 11 THEN {_PICK(_CATEGORIES, 'id % 12')} END AS task_category, CASE WHEN {_KEPT} THEN 'Math|t' || id END AS other_task_category, CASE WHEN {_KEPT} THEN 'tagger' END AS task_category_generator,
  {_made_sql('id', _TURNS)} AS llama_guard_2, {_score_sql(_TURNS)} AS instruct_reward, 'rm' AS reward_model, CASE WHEN i <> '' AND f > 3 THEN {_CODE} END AS language FROM b"""


@query("sft_conversations", _SFT)
def sft_conversations(spark, sf_dir):
    said = F.array_join(F.transform("conversations", lambda m: F.concat(m["from"], F.lit(":"), m["value"])), "|").alias("conversations")
    config = F.concat_ws("|", *(F.col(f"gen_input_configs.{c}").cast("string") for c in ("temperature", "top_p", "input_generator", "seed", "pre_query_template"))).alias("gen_input_configs")
    flat = {"conversations": said, "gen_input_configs": config, "other_task_category": F.array_join("other_task_category", "|").alias("other_task_category")}
    return _sft(spark, sf_dir).select(*[flat.get(c, F.col(c)) for c in curate.COLUMNS])


_GENERATORS = """(SELECT doc_id, CASE WHEN doc_id % 13 = 3 THEN NULL WHEN doc_id % 17 = 4 THEN 'org/other' ELSE 'org/model-a' END AS made,
  CASE WHEN doc_id % 11 = 5 THEN NULL WHEN doc_id % 7 = 2 THEN 'org/model-b' WHEN doc_id % 17 = 4 THEN 'org/other' ELSE 'org/model-a' END AS answered FROM documents)"""
_VIOLATED = "CASE WHEN made IS NULL OR answered IS NULL THEN 'missing' WHEN made <> answered THEN 'differ' WHEN NOT contains(made, 'model-a') THEN 'foreign' END"
_COUNTED = ", ".join(f"count(*) FILTER (v = '{v}') AS n_{v}, min(doc_id) FILTER (v = '{v}') AS first_{v}" for v in curate.VIOLATIONS)


@query("a1_assertions", f"SELECT count(*) AS n_rows, {_COUNTED} FROM (SELECT doc_id, {_VIOLATED} AS v FROM {_GENERATORS})")
def a1_assertions(spark, sf_dir):
    """The generator rules over all rows, counted while they are written."""
    d = F.col("doc_id")
    made = F.when(d % 13 == 3, None).when(d % 17 == 4, "org/other").otherwise("org/model-a")
    answered = F.when(d % 11 == 5, None).when(d % 7 == 2, "org/model-b").when(d % 17 == 4, "org/other").otherwise("org/model-a")
    rows = _docs(spark, sf_dir).select("doc_id", "text", F.struct(made.alias("input_generator")).alias("gen_input_configs"), F.struct(answered.alias("output_generator")).alias("gen_response_configs"))
    path = _folder(spark)
    rows, seen = curate.observed_generators(rows, "model-a", "doc_id")
    rows.write.parquet(path)
    shared.remove(spark, path)
    names = {"n_rows": "rows"} | {k: n for v in curate.VIOLATIONS for k, n in ((f"n_{v}", v), (f"first_{v}", f"{v}_first"))}
    return spark.createDataFrame([tuple(seen.get[n] for n in names.values())], ", ".join(f"{k} long" for k in names))


@query("k1_json_array", "SELECT doc_id, text, lang FROM documents")
def k1_json_array(spark, sf_dir):
    """One JSON array in one file, written by the tasks and read back."""
    rows, path = _docs(spark, sf_dir).select("doc_id", "text", "lang"), f"{_folder(spark)}.json"
    datasets.write_json_array(rows, path)
    return datasets.read_dataset(spark, path, rows.schema)
