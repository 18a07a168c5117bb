"""Conversion to conversations, selection and ordering of tagged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.tags import CATEGORY, DIFFICULTY, QUALITY, whitelist
from ..sources.shared import remove
from .positions import hashed, numbered, top_by


def high_quality(df: DataFrame, quality: str = "input_quality", reward: str = "instruct_reward", text: str = "instruction", near: str = "min_similar_conversation_id", key: str = "conversation_id", least: float = -10.0) -> DataFrame:
    """Good or excellent, reward above the bound (null fails), no trailing colon, its own representative or without one."""
    own = F.col(near).isNull() | (F.col(near) == F.col(key))
    return df.where(F.col(quality).isin("good", "excellent") & (F.col(reward) > least) & ~F.col(text).endswith(":") & own)


def longest(df: DataFrame, n: int = 300_000, text: str = "response", tie: str = "row_idx") -> DataFrame:
    """The n rows of longest text, by code points; ties by row order, an integer. Null texts are never among them unless all rows are. The cut-off is found first, see positions.top_by."""
    return top_by(df.withColumn("response_length", F.length(text)), F.col("response_length"), tie, n)


def with_least_equal(df: DataFrame, text: str, key: str, out: str) -> DataFrame:
    """df with the least key of the rows of equal text. Only 128 bits of hash and the keys are shuffled; two hashes of different seeds agree for different texts with odds of 2^-128 a pair."""
    hashes = {"_h": F.xxhash64(text), "_g": F.xxhash64(F.lit(7), text)}
    least = df.select(key, *(h.alias(n) for n, h in hashes.items())).groupBy(*hashes).agg(F.min(key).alias(out), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return df.withColumns(hashes).join(least, [*hashes], "left").drop(*hashes).withColumn(out, F.coalesce(out, key))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A fixed order by a hash of seed and key (positions.hashed), ties by key, the same for any partitioning."""
    return df.orderBy(hashed(key, seed), key)


def shuffled_places(df: DataFrame, key: str, seed: int = 42, out: str = "place", width: int = 1 << 44) -> DataFrame:
    """df with each row's place, from 0, in the order of `shuffled`. Hashes are spread evenly, so a block of `width` of the 2^60 holds a 65,536th of the rows."""
    rows = df.withColumns({"_h": hashed(key, seed), "_all": F.lit(0)})
    return numbered(rows, "_h", "_all", out, width, key).drop("_h", "_all")


def messages(instruction: Column, response: Column) -> Column:
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    return F.array(turn("human", instruction), turn("gpt", response))


def global_ids(df: DataFrame, prefix: str, file_col: str = "file_idx", id_col: str = "id") -> DataFrame:
    """conversation_id = prefix_(id + rows of all files before); the window is over one row per file."""
    counts = df.groupBy(file_col).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy(file_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(file_col, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    return df.join(F.broadcast(offsets), file_col).withColumn("conversation_id", F.concat(F.lit(prefix + "_"), F.col(id_col) + F.col("offset"))).drop("offset")


#: The columns of a conversation row.
COLUMNS = ["conversation_id", "instruction", "response", "conversations", "gen_input_configs", "intent", "knowledge", "difficulty", "difficulty_generator", "input_quality", "quality_explanation", "quality_generator", "task_category", "other_task_category", "task_category_generator", "llama_guard_2", "instruct_reward", "reward_model", "language"]


def to_conversations(df: DataFrame, prefix: str, strict_fix: bool = False) -> DataFrame:
    """The 19 columns of a conversation row; differing or foreign generators and missing columns are errors."""
    made, answered = F.col("gen_input_configs.input_generator"), F.col("gen_response_configs.output_generator")
    ok = F.when(made.isNull() | answered.isNull(), F.raise_error(F.lit("a generator is missing"))).when(made != answered, F.raise_error(F.lit("input and output generator differ"))).when(~made.contains(prefix), F.raise_error(F.lit("the id prefix isn't part of the generator")))
    rows = global_ids(df, prefix)
    rows = rows.where(F.coalesce(ok.cast("boolean"), F.lit(True)))
    return rows.withColumn("conversations", messages(F.col("instruction"), F.col("response"))).withColumn("gen_input_configs", F.col("gen_input_configs").withField("pre_query_template", F.col("pre_query_template"))).withColumn("difficulty", whitelist(F.col("difficulty"), DIFFICULTY)).withColumn("input_quality", whitelist(F.col("input_quality"), QUALITY)).withColumn("task_category", whitelist(F.col("task_category"), CATEGORY, strict_fix)).select(*COLUMNS)


#: Kinds of violations of the generator rules.
VIOLATIONS = ("missing", "differ", "foreign")


def _violation(prefix: str) -> Column:
    made, answered = F.col("gen_input_configs.input_generator"), F.col("gen_response_configs.output_generator")
    return F.when(made.isNull() | answered.isNull(), "missing").when(made != answered, "differ").when(~made.contains(prefix), "foreign")


def observed_generators(df: DataFrame, prefix: str, key: str = "conversation_id") -> tuple[DataFrame, Observation]:
    """df, and an observation that an action on it fills: rows, and for each kind of violation its count and least key. Nothing is scanned for it alone."""
    seen, kind = Observation(), _violation(prefix)
    kinds = [m for v in VIOLATIONS for m in (F.count_if(F.coalesce(kind == v, F.lit(False))).alias(v), F.min(F.when(kind == v, F.col(key))).alias(f"{v}_first"))]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *kinds), seen


def write_checked(df: DataFrame, prefix: str, path: str, key: str = "conversation_id") -> dict:
    """Writes df as Parquet and gives what was observed on the way; if any row breaks the generator rules, the output is removed and the error names counts and least keys of all kinds at once."""
    rows, seen = observed_generators(df, prefix, key)
    rows.write.mode("overwrite").parquet(path)
    found = seen.get
    bad = [f"{found[v]} {v} (first: {found[f'{v}_first']})" for v in VIOLATIONS if found[v]]
    if bad:
        remove(df.sparkSession, path)
        raise ValueError(f"generators of {found['rows']} rows: {', '.join(bad)}")
    return found


def long_turns(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, k, instruction, response: the k-th message of either side, any number of turns, one row each; a system turn isn't counted."""
    said = df.where(F.col(role).isin("user", "assistant"))
    said = said.withColumn("k", F.row_number().over(Window.partitionBy(key, role).orderBy(turn)))
    return said.groupBy(key, "k").agg(*(F.max(F.when(F.col(role) == who, F.col(text))).alias(name) for who, name in (("user", "instruction"), ("assistant", "response"))))


def debug_limit(df: DataFrame, n: int = 100, key: str = "row_idx") -> DataFrame:
    """The first n rows by their index."""
    return df.where(F.col(key) < n)


def batch_count(rows: Column, size: int) -> Column:
    """How many batches of a size hold so many rows."""
    return F.floor((rows + (size - 1)) / size)


def round_order(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """round and place: the rows of each round of n ids in a fixed shuffled order; no more than n rows meet in a window."""
    dealt = df.withColumn("round", F.floor(F.col(key) / n))
    mixed = F.sha1(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    return dealt.withColumn("place", F.row_number().over(Window.partitionBy("round").orderBy(mixed, key)).cast("long"))


def widen_turns(df: DataFrame, turns: int | None, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """instruction, response, instruction_2, response_2, ... from one row per message; a system turn isn't counted. turns None: as many as the data hold."""
    said = df.where(F.col(role).isin("user", "assistant"))
    order = Window.partitionBy(key, role).orderBy(turn)
    if turns is None:
        turns = said.groupBy(key, role).count().agg(F.max("count").alias("n")).first().n or 1
    said = said.withColumn("k", F.row_number().over(order)).where(F.col("k") <= turns)
    cells = [F.max(F.when((F.col(role) == who) & (F.col("k") == k), F.col(text))).alias(name if k == 1 else f"{name}_{k}") for k in range(1, turns + 1) for who, name in (("user", "instruction"), ("assistant", "response"))]
    return said.groupBy(key).agg(*cells)


def resume(source: DataFrame, done: DataFrame | None, key: str = "row_idx") -> DataFrame:
    """Rows whose key isn't staged yet."""
    return source if done is None else source.join(done.select(key), key, "left_anti")
