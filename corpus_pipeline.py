"""Corpus pipeline: quality classifier, exact dedup, near-duplicate join, decontamination, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and, but for
the last, returns the columns of documents. Only ids, hashes and verdicts leave the texts; a
stage then takes the dropped rows out by an anti-join on the row's key, its id and hashes of
its text, so rows that share an id are told apart.

Defined results of every stage: null and empty texts pass the quality stage, count as equal
to each other in the second and are never near-duplicates or contaminated; other columns are
carried along unread, whatever their names; an empty table gives an empty result. Rows that
share an id are judged by their own texts. Of rows equal in id and text (A-Z lower-cased) one
stays after the second stage; the text that sorts first, of wholly equal rows any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, exact_dedup, jaccard_join, quality_lm, sentencepiece_lattice
from tidewell.llm.common import documents, last_staged, remove, row_key, scratch, staged, table, without


def _keyed(docs: DataFrame) -> DataFrame:
    """key (see row_key) and text of each row."""
    return docs.select(row_key(docs["doc_id"], docs["text"]).alias("doc_id"), "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the language model accepts."""
    return quality_lm.accepted(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id (null before all)."""
    found = jaccard_join.similar_components(_keyed(docs)).where("doc_id <> component_id")
    return without(docs, row_key(docs["doc_id"], docs["text"]), found.select(F.col("doc_id").alias("gone")))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    found = decontaminate.contamination(_keyed(docs), table(spark, sf_dir, "benchmark")).where("contaminated")
    return without(docs, row_key(docs["doc_id"], docs["text"]), found.select(F.col("doc_id").alias("gone")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of each document left."""
    return sentencepiece_lattice.encode(docs, sentencepiece_lattice.load()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [("quality", quality), ("exact dedup", exact), ("near duplicates", near), ("decontamination", clean), ("encoding", encoded)]
#: The quality stage is a trained model and the last a merge loop: no SQL. A test compares run() with a plain restatement of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each is written, after which its input and what it staged on its way are deleted: no more than two corpora lie in the shared folder."""
    docs, path = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        made: list[DataFrame] = []
        with scratch(spark, lambda: made):  # noqa: B023  used at once
            made.append(staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}"))
        if path:
            remove(spark, path)
        docs, path = made[0], last_staged()
    return STAGES[-1][1](spark, docs, sf_dir)
