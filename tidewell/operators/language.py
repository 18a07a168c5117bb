"""A trained language detector: multinomial naive Bayes over hashed character n-grams of words."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import asked, small_batches

#: Longest n-gram, and cells of the model in all.
GRAMS, CELLS = 4, 1 << 22
_REST = re.compile(r"[\W\d_]+")


class Detector(Protocol):
    def detect(self, texts: list[str]) -> list[str | None]: ...


def buckets(text: str, size: int, grams: int = GRAMS) -> np.ndarray:
    """The bucket of each n-gram (1 to `grams` characters) of a text's letters in lower case, words set apart by single spaces; of nothing where there are no letters."""
    letters = _REST.sub(" ", text.lower()).strip()
    if not letters:
        return np.zeros(0, np.int64)
    points = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, code = [], np.zeros(len(points), np.uint64)
    for n in range(1, grams + 1):
        code = code[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
        mixed = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((mixed >> np.uint64(40)) % np.uint64(size))
    return np.concatenate(out).astype(np.int64)


class NgramDetector:
    """Weights (languages x buckets) and the languages' own log shares."""

    def __init__(self, names: list[str], weights: np.ndarray, shares: np.ndarray, grams: int = GRAMS):
        self.names, self.weights, self.shares, self.grams = names, weights, shares, grams

    def scores(self, text: str) -> np.ndarray | None:
        """Log-likelihood of each language; None for a text without letters, or if none was learned."""
        at = buckets(text, self.weights.shape[1], self.grams)
        if not len(at) or not self.names:
            return None
        seen, n = np.unique(at, return_counts=True)
        return self.shares + self.weights[:, seen] @ n

    def detect(self, texts: list[str]) -> list[str | None]:
        found = map(self.scores, texts)
        return [None if s is None else self.names[int(s.argmax())] for s in found]


def _first(rows: DataFrame, n: int) -> DataFrame:
    """Not part of learn(), which reads all rows. The n first rows by h (64 bits) and lang, of rows that agree in both any. The cut-off is found from counts, by the 16 leading bits and then by the keys of one such bucket, so texts don't meet in one task; only of equal keys at the cut-off, if not all are wanted, some are taken by a limit."""
    lead = F.shiftright("h", 48)
    before, cut = 0, None
    for bucket, count in sorted((r.b, r["count"]) for r in rows.groupBy(lead.alias("b")).count().collect()):  # 65,536 at most
        if before + count > n:
            cut = bucket
            break
        before += count
    if cut is None:
        return rows
    for h, lang, count in sorted(tuple(r) for r in rows.where(lead == cut).groupBy("h", "lang").count().collect()):
        if before + count > n:
            break
        before += count
    at = F.col("h") == h
    head = rows.where((F.col("h") < h) | at & (F.col("lang") < lang))
    return head.unionByName(rows.where(at & (F.col("lang") == lang)).limit(n - before)) if before < n else head


#: Buckets that a task holds before it adds them to its counts, and cells it sends at a time.
HELD = 1 << 18


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", grams: int = GRAMS) -> NgramDetector:
    """A detector from all rows that have a language and a text. N-grams are counted by tasks and summed by bucket; languages x buckets are CELLS at most, which is what the driver gets. A language's name is its upper-case code."""
    small_batches(df.sparkSession)
    rows = df.select(F.upper(df[lang_col]).alias("lang"), df[text_col].alias("text")).where("lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    names = sorted(counts)
    if not names:
        return NgramDetector([], np.zeros((0, 1)), np.zeros(0), grams)
    size = max(256, min(1 << 16, CELLS // len(names)))
    place = {n: i for i, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, n = np.zeros(len(names) * size, np.int64), [], 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append(buckets(text, size, grams) + place[lang] * size)
                n += len(held[-1])
                if n >= HELD:
                    np.add.at(table, np.concatenate(held), 1)
                    held, n = [], 0
        if held:
            np.add.at(table, np.concatenate(held), 1)
        cells = np.flatnonzero(table)
        for i in range(0, len(cells), HELD):
            at = cells[i : i + HELD]
            yield pa.record_batch([pa.array(at), pa.array(table[at])], ["cell", "n"])

    table = np.full(len(names) * size, 0.5)
    found = rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table[found.column("cell").to_numpy()] += found.column("n").to_numpy()
    table = table.reshape(len(names), size)
    total = sum(counts.values())
    return NgramDetector(names, np.log(table / table.sum(1, keepdims=True)), np.array([math.log(counts[n] / total) for n in names]), grams)


def detected(spark, detector: Detector, text: Column) -> Column:
    """The language of each text as an upper-case code; null for null and empty texts, and for those without letters. The detector is broadcast once."""
    shared = spark.sparkContext.broadcast(detector)

    def build():
        return lambda texts, _: [d if t else None for t, d in zip(texts, shared.value.detect(texts), strict=True)]

    return F.when(text != "", asked(build, "string", text))
