"""Ranked lexical search: every item of a query table against all documents, by a blocked sparse matrix product.

Terms are the maximal matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, only A-Z
lower-cased. The scores are the product of two sparse matrices: Q (items x terms, how often an
item has a term) and D (terms x documents, int64 impacts
w * ((10^9 tf) div (1000 tf + 8 m)), w = floor(1000 ln((2N + 2) / (2df + 1))),
m = 25 + (75 n N) div L). All but the logarithm is 64-bit integer arithmetic.

1. Query items are read by the driver in passes of about `max_item_bytes` of text: a pass's
   vocabulary and Q are broadcast, whatever the number of items.
2. Documents are cut into terms once a pass, in blocks of bounded bytes. Each task writes its
   documents' postings (terms of the vocabulary only) to a staged table, and beside them its
   sums: df by term, documents with terms, terms. So N, L and df are of all documents, and
   no text is shuffled.
3. The staged postings are read in blocks of about `block_docs` documents. A block's part of D
   is sorted by term; Gustavson's rule builds the product row by row: an item's row is the sum
   of the rows of D that its terms name, each times the multiplicity, merged in a dense
   accumulator of the block's documents. Of each row the k best documents leave the block; a
   task merges its blocks' lists as it goes, and one window merges the tasks' lists.

Defined results: null and empty texts, or texts without terms, have no terms: such documents
count neither in N nor L and are never ranked, such items have no rows. Documents that repeat
an id are ranked one by one. Item rows that repeat both id and text count once; rows that share
an id but not the text are items of their own. Documents with a null id stand before others
of the same score. No documents or no items: no rows. Other columns of either table, whatever
their names, are ignored. Scores stay below 2^63 for items of fewer than 10^8 terms.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, in_blocks, small_batches, staged, table
from .decontaminate import words

K = 10
_DOC, _TERM, _ALL = 0, 1, 2


class Items:
    """Q by rows over the items' own vocabulary."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.vocab: dict[bytes, int] = {}
        self.ids, self.rows = [], []
        for item, text in items:
            counts = Counter(words(text))
            if counts:
                self.ids.append(item)
                terms = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in counts], np.int64)
                self.rows.append((terms, np.array(list(counts.values()), np.int64)))


def _postings(batches: Iterator[pa.RecordBatch], vocab: dict[bytes, int], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """id, text -> a row for each document with terms (its length, terms of the vocabulary and their counts), then the task's sums: a row for each term (n: df) and one for all (term: documents, n: terms)."""
    df, docs, total = np.zeros(len(vocab), np.int64), 0, 0
    names = ["kind", "id", "n", "term", "terms", "tfs"]
    get, width = vocab.get, max(1, len(vocab))

    def sums(what: int, term: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(n), pa.binary())
        return pa.record_batch([pa.array(np.full(len(n), what, np.int32)), pa.nulls(len(n), kind), pa.array(n), pa.array(term), none, none], names)

    for b in in_blocks(batches, "text", 4 << 20):
        found, lens = [], []
        for t in b.column(1).to_pylist():
            w = words(t)
            lens.append(len(w))
            found += [get(x, -1) for x in w]
        lens = np.array(lens, np.int64)
        term = np.array(found, np.int64)
        doc = np.repeat(np.arange(len(lens)), lens)[term >= 0]
        key, tf = np.unique(doc * width + term[term >= 0], return_counts=True)
        doc, term = key // width, key % width
        df += np.bincount(term, minlength=len(df))
        docs, total = docs + int((lens > 0).sum()), total + int(lens.sum())
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(lens)))]).astype(np.int32) * 4
        terms, tfs = (pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(ends), pa.py_buffer(x.astype(np.int32))]) for x in (term, tf))
        out = pa.record_batch([pa.array(np.full(len(lens), _DOC, np.int32)), b.column(0), pa.array(lens), pa.nulls(len(lens), pa.int64()), terms, tfs], names)
        yield out.filter(pa.array(np.diff(ends) > 0))
    some = np.flatnonzero(df)
    yield sums(_TERM, some, df[some])
    yield sums(_ALL, np.array([docs]), np.array([total]))


class Scores:
    """Term weights and the documents' length rule, from the whole table's counts."""

    def __init__(self, items: Items, df: np.ndarray, docs: int, total: int):
        self.items, self.docs, self.total = items, docs, total
        self.weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)

    def block(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, document and score of each item's k best documents of a block; order: the documents' places by id."""
        m = 25 + (75 * n * self.docs) // self.total
        by = np.argsort(term, kind="stable")
        doc, term, tf = doc[by], term[by], tf[by].astype(np.int64)
        impact = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        first = np.searchsorted(term, np.arange(len(self.weight) + 1))
        found = []
        for i, (terms, times) in enumerate(self.items.rows):
            row = np.zeros(len(n), np.int64)
            for a, b, x in zip(first[terms].tolist(), first[terms + 1].tolist(), times.tolist(), strict=True):
                if a < b:
                    row[doc[a:b]] += x * impact[a:b]  # a document is in a row of D once
            at = np.flatnonzero(row > 0)
            if len(at) > k:
                least = np.partition(row[at], len(at) - k)[len(at) - k]
                at = at[row[at] >= least]
                at = at[np.lexsort((order[at], -row[at]))[:k]]
            found.append((np.full(len(at), i), at, row[at]))
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _best(rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of each item: greatest score, then least id."""
    by = pc.sort_indices(rows, [("item", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start")
    item = rows["item"].to_numpy()[by.to_numpy()]
    first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
    nth = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
    return rows.take(by.filter(pa.array(nth < k)))


def _ranked(batches: Iterator[pa.RecordBatch], scores: Scores, k: int, block_docs: int) -> Iterator[pa.RecordBatch]:
    """id, n, terms, tfs -> item (its row of Q), id, score: the task's k best documents of each item."""
    held, rows, kept = [], 0, None

    def product(block: list[pa.RecordBatch]) -> None:
        nonlocal kept
        t = pa.Table.from_batches(block).combine_chunks()
        counts = pc.binary_length(t["terms"]).to_numpy() // 4
        doc = np.repeat(np.arange(t.num_rows), counts)
        term, tf = (np.frombuffer(b"".join(t[c].to_pylist()), np.int32) for c in ("terms", "tfs"))
        order = np.empty(t.num_rows, np.int64)
        order[pc.sort_indices(t["id"], null_placement="at_start").to_numpy()] = np.arange(t.num_rows)
        item, at, score = scores.block(t["n"].to_numpy(), doc, term, tf, order, k)
        more = pa.table([pa.array(item, pa.int64()), t["id"].take(pa.array(at)), pa.array(score, pa.int64())], ["item", "id", "score"])
        kept = more if kept is None else pa.concat_tables([kept, more])
        if kept.num_rows > 8 * k * max(1, len(scores.items.rows)):
            kept = _best(kept, k)

    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= block_docs:
            product(held)
            held, rows = [], 0
    if held:
        product(held)
    if kept is not None and kept.num_rows:
        yield from _best(kept, k).combine_chunks().to_batches(10_000)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = K, max_item_bytes: int = 2 << 20, block_docs: int = 4096) -> DataFrame:
    """item, rank, id and score (named item_col, rank, id_col, score) of each item's k best documents."""
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    asked = items.select(items[item_col].alias("item"), items[item_text_col].alias("text")).where(F.length("text") > 0).distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    passes = max(1, -(-size // max_item_bytes))
    id_type, item_type = dict(src.dtypes)["id"], dict(asked.dtypes)["item"]
    kind = pa.schema(src.select("id").limit(0).toArrow().schema).field(0).type

    def one(no: int) -> DataFrame:
        part = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == no) if passes > 1 else asked
        q = Items([(r.item, r.text) for r in part.orderBy("item", "text").collect()])
        vocab = spark.sparkContext.broadcast(q.vocab)
        made = staged(src.mapInArrow(lambda it: _postings(it, vocab.value, kind), f"kind int, id {id_type}, n long, term long, terms binary, tfs binary"), "search-postings")
        vocab.destroy()
        total = made.where(F.col("kind") == _ALL).agg(F.sum("term").alias("docs"), F.sum("n").alias("terms")).first()
        df = np.zeros(len(q.vocab), np.int64)
        for r in made.where(F.col("kind") == _TERM).groupBy("term").agg(F.sum("n").alias("df")).collect():  # as many as the pass has terms
            df[r.term] = r.df
        scores = spark.sparkContext.broadcast(Scores(q, df, total.docs or 0, total.terms or 1))
        got = made.where(F.col("kind") == _DOC).select("id", "n", "terms", "tfs").mapInArrow(lambda it: _ranked(it, scores.value, k, block_docs), f"item long, id {id_type}, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("id"))
        got = got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        named = spark.createDataFrame(list(enumerate(q.ids)), f"item long, name {item_type}")
        return staged(got.join(F.broadcast(named), "item").select(F.col("name").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"), "search-ranked")

    return functools.reduce(DataFrame.unionByName, [one(i) for i in range(passes)])


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_TERMS} AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS iid, {_TERMS} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT iid, t, count(*) AS times FROM (SELECT iid, unnest(w) AS t FROM b) GROUP BY ALL),
tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) GROUP BY ALL),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
wt AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS wt FROM tf, s GROUP BY t, docs),
sized AS (SELECT rid, doc_id, 100 - 75 + (75 * len(w)::BIGINT * docs) // terms AS m FROM d, s WHERE len(w) > 0),
sc AS (SELECT iid, rid, sum(times * wt * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
       FROM q JOIN tf USING (t) JOIN wt USING (t) JOIN sized USING (rid) GROUP BY iid, rid),
r AS (SELECT iid, rid, score, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM sc JOIN sized USING (rid) WHERE score > 0 QUALIFY rank <= {K})
SELECT b.item_id, r.rank::INTEGER AS rank, d.doc_id, r.score FROM r JOIN b USING (iid) JOIN d USING (rid)
"""
