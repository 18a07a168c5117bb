"""Best-against-worst pairs from scored candidate responses, and an exact split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .positions import hashed


def collected(df: DataFrame, key: str, order: str, response: str, score: str) -> DataFrame:
    """responses[] and rewards[] per key, in sample order."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, response, score))).alias("all"))
    return rows.select(key, F.col(f"all.{response}").alias("responses"), F.col(f"all.{score}").alias("rewards"))


def best_worst(rewards: Column) -> tuple[Column, Column]:
    """1-based places of the greatest and the least reward, the first on ties; an empty list is an error."""
    checked = F.when(F.size(rewards) > 0, rewards).otherwise(F.raise_error(F.lit("no rewards")).cast("array<double>"))
    return F.array_position(checked, F.array_max(checked)), F.array_position(checked, F.array_min(checked))


def pairs(df: DataFrame, instruction: str = "instruction", responses: str = "responses", rewards: str = "rewards") -> DataFrame:
    best, worst = best_worst(F.col(rewards))
    turn = lambda who, what: F.struct(F.lit(who).alias("role"), what.alias("content"))
    talk = lambda at: F.array(turn("user", F.col(instruction)), turn("assistant", F.element_at(F.col(responses), at.cast("int"))))
    return df.withColumn("chosen", talk(best)).withColumn("rejected", talk(worst))


def split(df: DataFrame, key: str, share: float = 0.02, seed: int = 42) -> DataFrame:
    """is_test on exactly ceil(share * n) rows, those of least hash (positions.hashed), ties by key; ranks come from counts of hash ranges, so no task sees all rows."""
    rows = df.withColumn("_h", hashed(key, seed)).withColumn("_b", F.shiftright("_h", 48).cast("int"))
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("_b", F.coalesce(F.sum("n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    ranked = rows.join(F.broadcast(before), "_b").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    return ranked.withColumn("is_test", F.col("rank") <= F.ceil(F.lit(share) * F.col("all"))).drop("_h", "_b", "before", "all", "rank")
