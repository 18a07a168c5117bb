"""Line deduplication with a log-template tree, DataFrame and SQL functions only.

A line's tokens that hold a digit are variable fields and read `<*>`. The tree has fixed
depth: token count, then the first `depth` tokens; its leaf holds the distinct lines that
agree on those. In a group of lines, first a leaf, a position is constant if one token has
at least `dominance` of the group's distinct lines; if at least `similarity` of the positions
are constant, the group has a generalised template, and lines that match all its constants
belong to it. Each other line goes on to the group of those that share its most frequent
token at a position among those not dominant there, while it has one that two lines share;
so one leaf gives as many templates as it holds. A line left over is its own template. A template that occurs in at least `min_docs` different
documents is recurring, and its lines are dropped from every document. Beyond `short` words
the number falls with the length, to min_docs * short / words and to two at least, counted
in different texts.

All counts fold map-side; the joins on lines and templates are plain equi-joins between
written tables, which adaptive execution can split, so one very common line or leaf doesn't
end in one task. Lines are cut and masked once. Texts meet only the numbers of their dropped
lines, which are broadcast while their counted bytes are within `broadcast_bytes`.

Defined results: null and empty texts keep their (empty) text and have no lines dropped;
blank lines are never dropped; rows equal in id and text count as one document, as rows with
a null id do by their text; exactly `min_docs` documents, and exactly the share `dominance`,
are enough; of tokens equally frequent at a place the one of the greatest hash is its constant; an
empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, staged

#: A token that holds a digit, from its start on: no token is scanned twice.
_FIELD = r"(?<!\S)[^\s0-9]*[0-9]\S*"


def _masked(line):
    line = F.trim(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, _FIELD, "<*>")).otherwise(line)


def _needed(words: str, min_docs: int, short: int):
    """How many different texts make a line of so many words recurring."""
    return F.greatest(F.lit(min(2, min_docs)), F.ceil(min_docs * F.least(F.lit(1.0), short / F.col(words))))


def line_templates(rows: DataFrame, dominance: float, similarity: float, min_docs: int, short: int) -> DataFrame:
    """From distinct masked lines of leaves (h, leaf, t, hashes of the tokens, c, how often it occurs): h and tid of those that belong to a generalised template."""
    found, rows = [], rows.withColumnRenamed("leaf", "g")
    while True:
        cells = rows.select("g", "c", F.size("t").alias("w"), F.posexplode("t").alias("pos", "token")).groupBy("g", "pos", "token").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.max("w").alias("w"))
        cells = staged(cells, "lines-cells")
        best = cells.groupBy("g", "pos").agg(F.max(F.struct("n", "token")).alias("top"), F.sum("n").alias("all"))
        constant = F.when(F.col("top.n") >= dominance * F.col("all"), F.struct("pos", F.col("top.token").alias("token")))
        groups = staged(best.groupBy("g").agg(F.collect_list(constant).alias("fixed"), F.count(F.lit(1)).alias("width"), F.max("all").alias("all")).where("all > 1"), "lines-groups")
        member = (F.size("fixed") >= similarity * F.col("width")) & F.forall("fixed", lambda x: F.get("t", x["pos"]) == x["token"])
        placed = staged(rows.join(groups, "g").select("h", "g", "c", "t", "all", member.alias("member")), "lines-placed")
        found.append(placed.where("member").select("h", F.xxhash64(F.lit("leaf"), "g").alias("tid")))
        # The others go on by their most frequent token that isn't dominant. A new group has less than `dominance` of its old one's lines, so the rounds end.
        rest = placed.where("not member")
        usable = staged(cells.where((F.col("n") > 1) & (F.col("c") >= _needed("w", min_docs, short))).select("g", "pos", "token", "n"), "lines-usable")
        own = rest.select("h", "g", "all", F.posexplode("t").alias("pos", "token")).join(usable, ["g", "pos", "token"]).where(F.col("n") < dominance * F.col("all"))
        own = own.groupBy("h").agg(F.max(F.struct("n", (-F.col("pos")).alias("at"), "token")).alias("by"))
        rows = staged(rest.join(own, "h").select("h", F.xxhash64("g", "by.at", "by.token").alias("g"), "c", "t"), "lines-rest")
        if rows.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, short: int = 10, depth: int = 3, dominance: float = 0.6, similarity: float = 0.7, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Per row of docs: id, n_lines, n_dropped and the text without its recurring lines."""
    src = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    src = src.withColumn("rk", F.xxhash64("id", "text"))
    lines = src.select("rk", F.xxhash64("text").alias("tk"), F.posexplode(F.split("text", "\n")).alias("no", "line")).select("rk", "tk", "no", _masked("line").alias("masked")).where("masked <> ''")
    lines = lines.withColumn("t", F.split("masked", r"\s+")).select("rk", "tk", "no", F.xxhash64("masked").alias("h"), "masked", F.size("t").alias("w"), F.when(F.size("t") > depth, F.xxhash64(F.size("t"), F.slice("t", 1, depth))).alias("leaf"))
    lines = staged(lines.select("rk", "tk", "no", "h", "w", "leaf", F.when(F.col("leaf").isNotNull(), F.col("masked")).alias("masked")), "lines")
    slim = lines.drop("masked")
    # Only a leaf with the needed number of lines, two of them different, can hold a recurring template that isn't one line.
    wide = slim.where("leaf is not null").groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("x"), F.max("h").alias("y"), F.max("w").alias("w")).where((F.col("n") >= _needed("w", min_docs, short)) & (F.col("x") != F.col("y")))
    wide = staged(wide.select("leaf"), "lines-leaves")
    wide = F.broadcast(wide) if wide.count() * 16 <= broadcast_bytes else wide
    distinct = lines.select("h", "leaf", "masked").join(wide, "leaf", "left_semi").groupBy("h", "leaf", "masked").agg(F.count(F.lit(1)).alias("c"))
    distinct = staged(distinct.select("h", "leaf", F.transform(F.split("masked", r"\s+"), lambda x: F.xxhash64(x)).alias("t"), "c"), "lines-distinct")
    members = staged(line_templates(distinct, dominance, similarity, min_docs, short), "lines-members")
    members = F.broadcast(members) if members.count() * 32 <= broadcast_bytes else members
    known = slim.join(members, "h", "left").select("rk", "tk", "no", "w", F.coalesce("tid", "h").alias("tid"))
    known = staged(known, "lines-templates")
    # Copies of a text make up min_docs documents, but of the lower numbers each text counts once: a pair of copies isn't emptied.
    counted = known.groupBy("tid", "tk", "rk").agg(F.max("w").alias("w")).groupBy("tid", "tk").agg(F.count(F.lit(1)).alias("docs"), F.max("w").alias("w"))
    recurring = counted.groupBy("tid").agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("texts"), F.max("w").alias("w")).where((F.col("docs") >= min_docs) | (F.col("texts") >= _needed("w", min_docs, short)))
    recurring = staged(recurring.select("tid"), "lines-recurring")
    recurring = F.broadcast(recurring) if recurring.count() * 16 <= broadcast_bytes else recurring
    dropped = staged(known.join(recurring, "tid").groupBy("rk").agg(F.collect_set("no").alias("gone")), "lines-dropped")
    size = dropped.agg(F.coalesce(F.sum(32 + 4 * F.size("gone")), F.lit(0)).alias("n")).first().n
    dropped = F.broadcast(dropped) if size <= broadcast_bytes else dropped
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n"))
    out = src.join(dropped, "rk", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("text") == "", 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias(text_col))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("clean_sha256"))
