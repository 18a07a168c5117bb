"""Driver queries of the instruction-curation operators, by name, and their SQL.

The tables hold no tags, so the queries derive stand-ins that SQL can compute as well:
quality = one of five values by doc_id % 5, reward = doc_id * 37 % 61 - 30, representative =
least doc_id of equal texts. They are fixtures, not judgements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tags, text
from ..operators import curate, language, models, neighbours, positions, preference

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text", "source")
    return curate.with_least_equal(docs, "text", "doc_id", "rep").select(
        F.col("doc_id").alias("row_idx"), F.col("doc_id").alias("conversation_id"), F.col("text").alias("instruction"), F.col("text").alias("response"), "source",
        F.get(F.array(*map(F.lit, tags.QUALITY)), (F.col("doc_id") % 5).cast("int")).alias("input_quality"), (F.col("doc_id") * 37 % 61 - 30).cast("double").alias("instruct_reward"), F.col("rep").alias("min_similar_conversation_id"),
    )


_TAGGED = """(SELECT doc_id, text, source, ['very poor','poor','average','good','excellent'][CAST(doc_id % 5 AS INT) + 1] AS quality,
  CAST(doc_id * 37 % 61 - 30 AS DOUBLE) AS reward, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents)"""
_GOOD = f"SELECT * FROM {_TAGGED} WHERE quality IN ('good','excellent') AND reward > -10 AND NOT ends_with(text, ':') AND (rep IS NULL OR rep = doc_id)"


@query("f5_high_quality", f"SELECT doc_id, length(text) AS response_length FROM ({_GOOD}) ORDER BY response_length DESC, doc_id LIMIT 300000")
def f5_high_quality(spark, sf_dir):
    return curate.longest(curate.high_quality(_tagged(spark, sf_dir))).select(F.col("row_idx").alias("doc_id"), F.col("response_length").cast("long").alias("response_length"))


@query("o3_top_k", "SELECT doc_id, length(text) AS response_length FROM documents ORDER BY length(text) DESC, doc_id LIMIT 100")
def o3_top_k(spark, sf_dir):
    return curate.longest(_docs(spark, sf_dir), 100, "text", "doc_id").select("doc_id", F.col("response_length").cast("long").alias("response_length"))


_RAW_TAG = f"CASE WHEN length(text) % 4 = 3 THEN text ELSE {[*tags.CATEGORY[:-1], 'Others', 'math', 'Other']!r}[CAST(length(text) % 14 AS INT) + 1] END"
_TAG_LIST = ", ".join(f"'{c}'" for c in tags.CATEGORY)


@query("r6_whitelist", f"SELECT doc_id, CASE WHEN t IN ({_TAG_LIST}) THEN t END AS category, CASE WHEN t = 'Others' THEN 'Other' WHEN t IN ({_TAG_LIST}) THEN t END AS fixed FROM (SELECT doc_id, {_RAW_TAG} AS t FROM documents)")
def r6_whitelist(spark, sf_dir):
    """Every category by the text's length, known and unknown spellings, and the whole text itself."""
    raw = F.when(F.length("text") % 4 == 3, F.col("text")).otherwise(F.get(F.array(*map(F.lit, [*tags.CATEGORY[:-1], "Others", "math", "Other"])), (F.length("text") % 14).cast("int")))
    return _docs(spark, sf_dir).select("doc_id", tags.whitelist(raw, tags.CATEGORY).alias("category"), tags.whitelist(raw, tags.CATEGORY, True).alias("fixed"))


_NUMBERED = "SELECT doc_id, source, dense_rank() OVER (ORDER BY source) - 1 AS file_idx, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS id FROM documents"


@query("r5_global_ids", f"WITH d AS ({_NUMBERED}), c AS (SELECT file_idx, count(*) AS n FROM d GROUP BY file_idx) SELECT doc_id, 'part_' || (id + coalesce((SELECT sum(n) FROM c WHERE c.file_idx < d.file_idx), 0)) AS conversation_id FROM d")
def r5_global_ids(spark, sf_dir):
    rows = positions.numbered(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id", "source")
    return curate.global_ids(rows, "part", "source", "id").select("doc_id", "conversation_id")


@query("r3_messages", "SELECT doc_id, 'human' AS first_from, text AS first_value, 'gpt' AS second_from, source AS second_value FROM documents")
def r3_messages(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", curate.messages(F.col("text"), F.col("source")).alias("m"))
    return rows.selectExpr("doc_id", "m[0].`from` as first_from", "m[0].value as first_value", "m[1].`from` as second_from", "m[1].value as second_value")


_SHUFFLED = "substr(sha1('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15), doc_id"


@query("o4_shuffle", f"SELECT doc_id, row_number() OVER (ORDER BY {_SHUFFLED}) - 1 AS place FROM documents")
def o4_shuffle(spark, sf_dir):
    return curate.shuffled_places(_docs(spark, sf_dir).select("doc_id"), "doc_id")


@query("o6_split", f"SELECT doc_id, row_number() OVER (ORDER BY {_SHUFFLED}) <= ceil(0.02 * count(*) OVER ()) AS is_test FROM documents")
def o6_split(spark, sf_dir):
    return preference.split(_docs(spark, sf_dir).select("doc_id"), "doc_id").select("doc_id", "is_test")


def _scored(spark, sf_dir):
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'")
    return said.select("conv_id", "turn", "text", ((F.col("turn") * 31 + F.col("conv_id") * 17) % 7).cast("double").alias("score"))


_SCORED = "(SELECT conv_id, turn, text, CAST((turn * 31 + conv_id * 17) % 7 AS DOUBLE) AS score FROM conversations WHERE role = 'assistant')"


@query("g1_best_worst", f"SELECT conv_id, (array_agg(text ORDER BY score DESC, turn))[1] AS chosen, (array_agg(text ORDER BY score, turn))[1] AS rejected, count(*) AS n FROM {_SCORED} GROUP BY conv_id")
def g1_best_worst(spark, sf_dir):
    lists = preference.collected(_scored(spark, sf_dir), "conv_id", "turn", "text", "score").withColumn("instruction", F.lit("q"))
    return preference.pairs(lists).selectExpr("conv_id", "chosen[1].content as chosen", "rejected[1].content as rejected", "cast(size(responses) as long) as n")


_TURN = "max(CASE WHEN role = '{r}' AND k = {k} THEN text END) AS {n}"
_TURNS = ", ".join(_TURN.format(r=r, k=k, n=n if k == 1 else f"{n}_{k}") for k in (1, 2, 3) for r, n in (("user", "instruction"), ("assistant", "response")))


@query("mt_widen_turns", f"SELECT conv_id, {_TURNS} FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations WHERE role IN ('user', 'assistant')) WHERE k <= 3 GROUP BY conv_id")
def mt_widen_turns(spark, sf_dir):
    return curate.widen_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), 3)


@query("mt_widen_turns_all")
def mt_widen_turns_all(spark, sf_dir):
    return curate.widen_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), None)


@query("mt_turns_long", "SELECT conv_id, k, max(CASE WHEN role = 'user' THEN text END) AS instruction, max(CASE WHEN role = 'assistant' THEN text END) AS response FROM (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS INT) AS k FROM conversations WHERE role IN ('user', 'assistant')) GROUP BY conv_id, k")
def mt_turns_long(spark, sf_dir):
    return curate.long_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_KNN = "WITH p AS (SELECT a.vec_id, b.vec_id AS nid, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))) AS d FROM embeddings a, embeddings b), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, nid) AS rk FROM p)"


def _neighbours(spark, sf_dir, k):
    found = neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k).where("nid <> id")
    return found.select(F.col("id").alias("vec_id"), "nid", F.col("rank").cast("long").alias("rk"), F.round("d", 4).alias("d"))


@query("j1_nearest", _KNN + " SELECT vec_id, nid, rk, round(d, 4) AS d FROM r WHERE rk <= 5 AND nid <> vec_id")
def j1_nearest(spark, sf_dir):
    return _neighbours(spark, sf_dir, 5)


@query("j1_nearest_500", _KNN + " SELECT vec_id, nid, rk, round(d, 4) AS d FROM r WHERE rk <= 500 AND nid <> vec_id")
def j1_nearest_500(spark, sf_dir):
    return _neighbours(spark, sf_dir, 500)


@query("j4_near_duplicates", _KNN + " SELECT vec_id, round(min(d) FILTER (nid <> vec_id), 4) AS min_neighbor_distance, count(*) FILTER (nid <> vec_id AND d < 1.2) AS repeat_count, least(vec_id, min(nid) FILTER (nid <> vec_id AND d < 1.2)) * CASE WHEN count(*) FILTER (nid <> vec_id AND d < 1.2) > 0 THEN 1 END AS representative FROM r WHERE rk <= 500 GROUP BY vec_id")
def j4_near_duplicates(spark, sf_dir):
    out = neighbours.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 1.2)
    return out.withColumn("min_neighbor_distance", F.round("min_neighbor_distance", 4))



def _derived(body="text"):
    return F.concat(F.when(F.col("doc_id") % 4 == 0, "Task: ").when(F.col("doc_id") % 4 == 1, "1. ").when(F.col("doc_id") % 4 == 2, "**Question** ").otherwise(""), body, F.when(F.col("doc_id") % 3 == 0, "?").when(F.col("doc_id") % 3 == 1, ":\nrest").otherwise(" The answer is: 4"))


_DERIVED_SQL = "(SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN 'Task: ' WHEN 1 THEN '1. ' WHEN 2 THEN '**Question** ' ELSE '' END, text, CASE doc_id % 3 WHEN 0 THEN '?' WHEN 1 THEN chr(58) || chr(10) || 'rest' ELSE ' The answer is: 4' END) AS t FROM documents)"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '\\A{text.WS}+|{text.WS}+\\z', '', 'g')"


def _prefix_sql(x: str) -> str:
    """A leading number or mark, then one leading task word."""
    words = "|".join(v for w in text.PREFIXES for v in (f"{w}:", rf"\*\*{w}\*\*", f"## {w}:"))
    numbered = _strip_sql(rf"regexp_replace({x}, '\A(?:\p{{Nd}}+\.|[\p{{L}}\p{{N}}_]+\)){text.WS}*', '')")
    return _strip_sql(rf"regexp_replace({numbered}, '(?i)\A(?:{words}|Question \p{{Nd}}+:|Question \p{{Nd}}+\.|Part \p{{Nd}}+:|Q\p{{Nd}}+\.|Q\p{{Nd}}+:){text.WS}*', '')")


def _sanitized_sql(llama: bool, rows: str = _DERIVED_SQL) -> str:
    """The decision table of the sanitiser, rule by rule, over doc_id and t of rows."""
    mark, step = "(?:" + "|".join(text.MARKERS) + ")s?:", "(?:" + "|".join(text.STEPS) + "):?"
    line, upto = _strip_sql("split_part(s, chr(10), 1)"), _strip_sql("split_part(s, '?', 1)") + " || '?'"
    gone = lambda x, what: _strip_sql(f"replace({x}, '{what}', '')")
    bold = lambda x: f"CASE WHEN instr({x}, '**') = 2 THEN {gone(x, '**')} ELSE {_strip_sql(x)} END"
    bare = lambda x: bold(_strip_sql(x))
    a, b, c, d, e = (6.1, 6.2, 6.3, 99.1, 99.2) if llama else (5.1, 5.2, 5.3, 6.1, 6.2)
    rules = [
        ("starts_with(f, '*') AND contains(f, '?')", gone("split_part(f, '?', 1)", "*") + " || '?'", 1.0),
        ("starts_with(s, chr(34)) AND contains(s, '?')", gone("split_part(s, '?', 1)", '"') + " || '?'", 2.1),
        ("starts_with(s, chr(34))", gone(gone("split_part(s, chr(10), 1)", '"'), "*"), 2.2),
        ("starts_with(s, '<b>')", gone("s", "*"), 3.0),
        ("mark IS NOT NULL", bare("substr(s, 1, mark)"), 4.0),
        *([("step IS NOT NULL", bare("substr(s, 1, step)"), 5.0)] if llama else []),
        ("ends_with(line, ':') AND contains(s, '#')", bare("split_part(s, '#', 1)"), a),
        ("ends_with(line, ':') AND contains(s, '?')", bold(f"({upto})"), b),
        ("ends_with(line, ':')", gone("line", "*"), c),
        ("contains(s, '?')", bold(f"({upto})"), d),
        ("true", gone("line", "*"), e),
    ]
    first = " ".join(f"WHEN {test} THEN {made}" for test, made, _ in rules)
    number = " ".join(f"WHEN {test} THEN {n}" for test, _, n in rules)
    return f"""WITH f AS (SELECT doc_id, {_prefix_sql('t')} AS f FROM {rows}),
s AS (SELECT doc_id, f, {_prefix_sql('f')} AS s, CASE WHEN regexp_matches(f, '{mark}') THEN length(string_split_regex(f, '{mark}')[1]) END AS mark, CASE WHEN regexp_matches(f, '{step}') THEN length(string_split_regex(f, '{step}')[1]) END AS step FROM f),
l AS (SELECT *, {line} AS line FROM s), r AS (SELECT doc_id, CASE {first} END AS made, CAST(CASE {number} END AS DOUBLE) AS class FROM l)
SELECT doc_id, {_prefix_sql('made')} AS instruction, class FROM r"""


@query("c2_remove_prefix", f"SELECT doc_id, {_prefix_sql('t')} AS instruction FROM {_DERIVED_SQL}")
def c2_remove_prefix(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.remove_prefix(_derived()).alias("instruction"))


QUERIES["c2_remove_prefix_whole"] = c2_remove_prefix
ORACLE_SQL["c2_remove_prefix_whole"] = ORACLE_SQL["c2_remove_prefix"]


def _sanitized(family: str):
    def run(spark, sf_dir):
        return _docs(spark, sf_dir).select("doc_id", text.sanitize(_derived(), family).alias("s")).select("doc_id", "s.instruction", "s.class")

    return run


query("c5_sanitize_gemma", _sanitized_sql(False))(_sanitized("google/gemma-2-9b-it"))
query("c6_sanitize_llama", _sanitized_sql(True))(_sanitized("meta-llama/Llama-3.1-8B-Instruct"))
for _name in ("c7_sanitize_other", "c7_sanitize_other_whole"):
    query(_name, f"SELECT doc_id, t AS instruction, CAST(0 AS DOUBLE) AS class FROM {_DERIVED_SQL}")(_sanitized("other"))


@query("c8_stop_tokens", "SELECT doc_id, CASE WHEN contains(text, '. ') THEN split_part(text, '. ', 1) WHEN contains(text, chr(10)) THEN split_part(text, chr(10), 1) ELSE text END AS cut FROM documents")
def c8_stop_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.cut_at_stop(F.col("text"), ["\n", ". "]).alias("cut"))


@query("c4_next_newline", "SELECT doc_id, CAST(instr(text, chr(10)) - 1 AS BIGINT) AS at, length(text) AS input_length FROM documents")
def c4_next_newline(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.next_newline(F.col("text")).cast("long").alias("at"), F.length("text").cast("long").alias("input_length"))


@query("c10_repair_tags", "SELECT doc_id, regexp_extract('{' || chr(10) || t, '^.*\\}', 0, 's') AS tags, '{' || t || '}' AS api FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '\"a\": 1} tail' ELSE text END AS t FROM documents)")
def c10_repair_tags(spark, sf_dir):
    t = F.when(F.col("doc_id") % 2 == 0, '"a": 1} tail').otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", text.repair_tags(t).alias("tags"), text.repair_tags_api(t).alias("api"))


@query("c12_parse_tags", f"SELECT doc_id, doc_id % 7 <> 0 AS ok, CASE WHEN doc_id % 7 <> 0 THEN 'i' END AS intent, CAST(NULL AS VARCHAR) AS knowledge, CASE WHEN doc_id % 7 <> 0 THEN {tags.DIFFICULTY!r}[CAST(doc_id % 5 AS INT) + 1] END AS difficulty FROM documents")
def c12_parse_tags(spark, sf_dir):
    made = F.concat(F.lit('{"intent": "i", "knowledge": null, "difficulty": "'), F.get(F.array(*map(F.lit, tags.DIFFICULTY)), (F.col("doc_id") % 5).cast("int")), F.when(F.col("doc_id") % 7 == 0, '"} x').otherwise('"}'))
    return _docs(spark, sf_dir).select("doc_id", tags.parse_tags(made, "difficulty").alias("t")).select("doc_id", "t.*")


_ANSWERS = "(SELECT *, CAST(doc_id % 8 AS INT) AS kind FROM documents)"


@query("c12_strict_json", f"""SELECT doc_id, kind IN (0, 1, 5, 6) AS ok, CASE kind WHEN 0 THEN text WHEN 5 THEN source || text WHEN 6 THEN '{{"a":[1,"' || source || '"]}}' END AS intent,
  CASE WHEN kind IN (0, 1, 6) THEN source END AS knowledge, CASE WHEN kind IN (0, 1, 5, 6) THEN text END AS difficulty FROM {_ANSWERS}""")
def c12_strict_json(spark, sf_dir):
    """Answers made of whole texts: good ones, a null, trailing text, a lacking key, single quotes, a repeated key, a nested value, and the bare text."""
    text_, source = [F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "") for c in ("text", "source")]
    built = lambda intent, tail="": F.concat(F.lit('{"intent" : '), intent, F.lit(', "knowledge":'), source, F.lit(',\n"difficulty":'), text_, F.lit("}" + tail))
    kind = F.col("doc_id") % 8
    made = F.when(kind == 0, built(text_)).when(kind == 1, built(F.lit("null"), " \n")).when(kind == 2, built(text_, " done")).when(kind == 3, F.concat(F.lit('{"intent":'), text_, F.lit("}")))
    made = made.when(kind == 4, F.translate(built(source), '"', "'")).when(kind == 5, F.concat(F.lit('{"intent":1,"difficulty":'), text_, F.lit(',"knowledge":null,"intent":'), F.regexp_replace(F.to_json(F.array(F.concat("source", "text"))), r"^\[|\]$", ""), F.lit("}")))
    made = made.when(kind == 6, built(F.concat(F.lit('{"a" : [1, '), source, F.lit("]}")))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", tags.parse_tags(made, "difficulty").alias("t")).select("doc_id", "t.*")


_PROMPTS = ", ".join("sha256('{}' || text || '{}') AS {}".format(*(x.replace("'", "''") for x in tags.around(m)), m) for m in tags.MISSIONS)


@query("c13_prompts", f"SELECT doc_id, {_PROMPTS} FROM documents")
def c13_prompts(spark, sf_dir):
    """Digests of whole prompts."""
    return _docs(spark, sf_dir).select("doc_id", *[F.sha2(tags.prompt(m, F.col("text")), 256).alias(m) for m in tags.MISSIONS])


_HASH = "sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(text))"


@query("c18_uuid5", f"SELECT doc_id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3), substr(h, 21, 12)) AS uuid FROM (SELECT doc_id, {_HASH} AS h FROM documents)")
def c18_uuid5(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.uuid5(F.col("text")).alias("uuid"))


@query("s10_resume", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def s10_resume(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id")
    return curate.resume(docs, docs.where("doc_id % 3 = 0"), "doc_id")


@query("s11_debug_limit", "SELECT doc_id FROM documents WHERE doc_id < 100")
def s11_debug_limit(spark, sf_dir):
    return curate.debug_limit(_docs(spark, sf_dir), 100, "doc_id").select("doc_id")


@query("g6_counts", "SELECT source, count(*) AS n, (count(*) + 127) // 128 AS batches FROM documents GROUP BY source")
def g6_counts(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("batches", curate.batch_count(F.col("n"), 128))


def _made_sql(seed: str, prompt: str) -> str:
    """What the stub generator says."""
    return f"substr(sha1(concat({seed}, ':', {prompt})), 1, 12)"


@query("m1_generate", f"SELECT doc_id, CAST(r AS INT) AS round, doc_id * 3 + r AS id, {_made_sql('doc_id * 3 + r', "'<system>' || coalesce(text, '') || '<user>'")} AS instruction FROM documents, range(3) t(r)")
def m1_generate(spark, sf_dir):
    """Three instructions from each document as a system prompt."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return models.instructions_of(docs, models.StubGenerator, "<system>{system}<user>", 3, "doc_id", "text")


@query("m2_respond", f"SELECT doc_id, {_made_sql('doc_id', 'text')} AS response FROM documents")
def m2_respond(spark, sf_dir):
    return models.generate(_docs(spark, sf_dir).select("doc_id", "text"), models.StubGenerator, "text", "doc_id", "response").select("doc_id", "response")


@query("m5_samples")
def m5_samples(spark, sf_dir):
    return models.samples(_docs(spark, sf_dir).select("doc_id", "text"), models.StubGenerator, 4, "text", "doc_id").select("doc_id", "responses")


@query("m11_language")
def m11_language(spark, sf_dir):
    """A detector learned from all rows but a fifth that is held out, by crc32(doc_id), and what it says of all rows."""
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    made = language.learn(docs.where(~held))
    return docs.select("doc_id", "lang", held.alias("held_out"), language.detected(spark, made, F.col("text")).alias("language"))
