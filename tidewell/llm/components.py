"""Connected components of a table of links, by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """From links (a, b): node and comp, the least node it can reach. Each round is cut by a written table; every join is an equi-join that can be split, every fold is partial first."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    both = staged(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = staged(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("comp")), "cc-labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("u"), "comp"), "u").groupBy(F.col("v").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.least("comp", "near").alias("low"), F.col("comp").alias("was"))
        # A node's label is itself a node: take that node's own label.
        jump = step.join(labels.select(F.col("node").alias("low"), F.col("comp").alias("far")), "low").select("node", F.least("low", "far").alias("comp"), "was")
        moved = staged(jump, "cc-labels")
        labels = moved.select("node", "comp")
        if moved.where("comp <> was").isEmpty():
            return labels
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
