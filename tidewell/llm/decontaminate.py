"""Benchmark decontamination by suffix arrays over the training documents.

Every block of documents is one shard: its words become ranks in the benchmark's
vocabulary, its suffixes are sorted (prefix doubling, to the window length), and every
distinct window of the test suffixes is binary-searched in the sorted order. Hit words are
marked by differences, so equal windows cost nothing twice. From hit to hit the places in
items that go on matching are carried along, which gives the longest verbatim match at each
word; one is listed if no match that begins before covers it, whichever item it is of.

The benchmark's side is read by the driver in passes of about `max_bench_bytes`, by item,
one at a time: a pass's table is broadcast, its hits are written, the table is freed, and the
hits of all passes, rows of hit documents only, are put together by document. Which matches are
listed is settled over all passes, so that their number doesn't change the result.

Words: `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A window is
`window` consecutive words of an item; a shorter item, but not an empty one, is one
window. Defined results: null and empty texts have no words and no hits; repeated items
count once by their id; null item ids are skipped in lists of ids but their windows hit; rows
that repeat an id are judged one by one; of equally long matches at a word the item is named
whose id as text sorts first (null ids last), and of that the earliest word. An empty benchmark hits nothing, an empty table gives an
empty result. Other columns of either table, whatever their names, are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_blocks, documents, row_key, staged, table

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


class Windows:
    """The benchmark's windows and suffixes over a vocabulary of its own words."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.window, self.vocab, self.ids = window, {}, []
        seqs = []
        for item, text in items:
            w = words(text)
            if w:
                self.ids.append(item)
                seqs.append([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w])
        self.seqs = [np.array(s, np.int64) for s in seqs]
        #: Length to distinct windows, and per window its places: `places[first[i] : first[i + 1]]`. A place is an index into `item` and `at`; the next one is the next word of the item.
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        #: Items by their ids as text, null ids last; equal ids share a place.
        known = {x: n for n, x in enumerate(sorted({str(i) for i in self.ids if i is not None}))}
        self.rank = np.array([len(known) if i is None else known[str(i)] for i in self.ids], np.int64)
        self.item = np.concatenate([np.zeros(0, np.int64), *(np.full(len(s) + 1, i) for i, s in enumerate(self.seqs))])
        self.at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(s) + 1) for s in self.seqs)])
        base = np.cumsum([0, *(len(s) + 1 for s in self.seqs)])
        rows: dict[int, list[np.ndarray]] = {}
        places: dict[int, list[np.ndarray]] = {}
        for i, s in enumerate(self.seqs):
            n = min(window, len(s))
            rows.setdefault(n, []).append(np.lib.stride_tricks.sliding_window_view(s, n))
            places.setdefault(n, []).append(base[i] + np.arange(len(s) - n + 1))
        for n, found in rows.items():
            distinct, which = np.unique(np.concatenate(found), axis=0, return_inverse=True)
            which = which.ravel()
            by = np.argsort(which, kind="stable")
            self.by_length[n] = distinct, np.concatenate(places[n])[by], np.searchsorted(which[by], np.arange(len(distinct) + 1))


def _suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes sorted by their first `depth` words, and the sorted distinct keys of each doubling step, by which a query gets its rank."""
    rank, span, steps = ids.astype(np.int64), 1, []
    n = len(ids)
    while span < depth:
        shift = min(span, depth - span)
        nxt = np.zeros(n, np.int64)
        nxt[: n - shift] = rank[shift:]
        key = rank * (int(rank.max(initial=0)) + 1) + nxt
        distinct, new = np.unique(key, return_inverse=True)
        steps.append((shift, int(rank.max(initial=0)) + 1, distinct))
        rank, span = new.astype(np.int64) + 1, span + shift
    order = np.argsort(rank, kind="stable")
    return order, (rank, steps)


def _query_ranks(wins: np.ndarray, steps: list) -> np.ndarray:
    """Ranks of the windows in a suffix array by binary search, step by step; 0 where absent."""
    rank = wins.copy()
    for shift, base, distinct in steps:
        width = rank.shape[1] - shift
        a, b = rank[:, :width], rank[:, shift : shift + width]
        key = a * base + b
        pos = np.minimum(np.searchsorted(distinct, key), len(distinct) - 1)
        rank = np.where((distinct[pos] == key) & (a > 0) & (b > 0) & (a < base) & (b < base), pos + 1, 0)
    return rank[:, 0]


def match_block(texts: list[str | None], win: Windows):
    """Words per text, a flag per word (and per sentinel) that says if it is hit, item indexes per text, and the longest matches as (row, word, length, item index, item word)."""
    get = win.vocab.get
    rows = [[get(w, 0) for w in words(t)] for t in texts]
    lens = np.array([len(r) for r in rows], np.int64)
    # A sentinel of 0 after each text keeps matches inside it; words outside the vocabulary are 0 as well.
    flat = np.zeros(int(lens.sum()) + len(rows), np.int64)
    starts = np.concatenate([[0], np.cumsum(lens + 1)[:-1]]) if len(rows) else np.zeros(0, np.int64)
    for s, r in zip(starts, rows, strict=True):
        flat[s : s + len(r)] = r
    hit = np.zeros(len(flat) + 1, np.int64)
    pairs: list[np.ndarray] = []
    longest = []
    for n, (wins, places, first) in win.by_length.items():
        # Only suffixes whose first n words are all in the vocabulary can begin a match: the shard's array holds those.
        bad = np.concatenate([[0], np.cumsum(flat == 0)])
        if len(flat) < n:
            continue
        ok = np.flatnonzero(bad[n:] == bad[:-n])
        if not len(ok):
            continue
        live = np.zeros(len(flat), bool)
        for j in range(n):
            live[ok + j] = True
        keep = np.flatnonzero(live)
        comp = np.zeros(len(keep) + np.count_nonzero(np.diff(keep) > 1) + 1, np.int64)
        new_at = np.arange(len(keep)) + np.concatenate([[0], np.cumsum(np.diff(keep) > 1)])
        comp[new_at] = flat[keep]
        back = np.zeros(len(comp), np.int64)
        back[new_at] = keep
        order, (rank, steps) = _suffix_array(comp, n)
        if steps:
            wanted = _query_ranks(wins, steps)
        else:
            wanted = wins[:, 0]
        sorted_rank = rank[order]
        lo, hi = np.searchsorted(sorted_rank, wanted, "left"), np.searchsorted(sorted_rank, wanted, "right")
        lo = np.where(wanted > 0, lo, hi)
        count = hi - lo
        if not count.sum():
            continue
        which = np.repeat(np.arange(len(wins)), count)
        pos = order[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        pos = back[pos]
        np.add.at(hit, pos, 1)
        np.add.at(hit, pos + n, -1)
        doc = np.searchsorted(starts, pos, "right") - 1
        each = np.unique(doc * len(wins) + which)
        d, w = each // len(wins), each % len(wins)
        many = first[w + 1] - first[w]
        place = np.repeat(first[w], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs.append(np.unique(np.repeat(d, many) * len(win.ids) + win.item[places[place]]))
        longest += _longest(win, n, places, first, pos, which, doc, starts)
    items: list[list[int]] = [[] for _ in rows]
    for key in np.unique(np.concatenate(pairs)).tolist() if pairs else ():
        items[key // len(win.ids)].append(key % len(win.ids))
    return lens, np.cumsum(hit)[:-1] > 0, items, longest


def _longest(win: Windows, n: int, places: np.ndarray, first: np.ndarray, pos: np.ndarray, which: np.ndarray, doc: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, word, length, item index, item word) of the longest matches of n words and more; a position has one window of a length at most."""
    back = np.argsort(-pos)
    more = np.zeros(len(win.item) + 1, np.int64)  # by place: how many words further the match at the position after goes on
    found, last, before = [], None, np.zeros(0, np.int64)
    for p, w, d in zip(pos[back].tolist(), which[back].tolist(), doc[back].tolist(), strict=True):
        own = places[first[w] : first[w + 1]]
        length = more[own + 1] + 1 if last == p + 1 else np.ones(len(own), np.int64)
        more[before] = 0
        more[own] = length
        last, before = p, own
        most = np.flatnonzero(length == length.max())
        best = int(most[np.lexsort((win.at[own[most]], win.rank[win.item[own[most]]]))[0]])
        size = int(length[best]) + n - 1
        if found and found[-1][1] == p + 1 and found[-1][2] == size - 1:
            found.pop()  # covered by this match
        found.append((d, p, size, int(win.item[own[best]]), int(win.at[own[best]])))
    return [(d, p - int(starts[d]), size, i, q) for d, p, size, i, q in found]


def outermost(matches: list[tuple]) -> list[tuple]:
    """Of (word, length, item as text or None, item word) those that no match beginning before covers, one a word."""
    out, to = [], 0
    for m in sorted(matches, key=lambda m: (m[0], -m[1], m[2] is None, m[2] or "", m[3])):
        if m[0] + m[1] > to:
            out.append(m)
            to = m[0] + m[1]
    return out


#: The same for an array of _MATCH.
_OUTERMOST = """aggregate(array_sort(transform(matches, x -> struct(x.word, -x.length AS short, x.item IS NULL AS unknown, x.item, x.item_word))),
  struct(cast(array() AS array<struct<word:bigint,length:bigint,item:string,item_word:bigint>>) AS kept, 0L AS to),
  (a, x) -> if(x.word - x.short > a.to, struct(concat(a.kept, array(struct(x.word AS word, -x.short AS length, x.item AS item, x.item_word AS item_word))) AS kept, x.word - x.short AS to), a)).kept"""
_MATCH = "struct<word:long,length:long,item:string,item_word:long>"


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", window: int = 10, max_bench_bytes: int = 16 << 20, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Per row of docs: id, n_words, n_hit, n_items, items (ids as strings, sorted), contaminated, and matches (the longest verbatim ones: word, length, item, item_word)."""
    spark = docs.sparkSession
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    items = bench.select(bench[item_col].alias("item"), bench[bench_text_col].alias("text")).where(F.length("text") > 0)
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    passes = max(1, -(-total // max_bench_bytes))
    match = pa.struct([("word", pa.int64()), ("length", pa.int64()), ("item", pa.string()), ("item_word", pa.int64())])

    def searched(rows: DataFrame, part: DataFrame, only_hit: bool) -> tuple[DataFrame, object]:
        """id, n_words, n_hit, spans (of hit words, ends exclusive), items and matches against one pass of the benchmark."""
        shared = spark.sparkContext.broadcast(Windows([(r.item, r.text) for r in part.orderBy("item", "text").collect()], window))

        def block(b: pa.RecordBatch) -> pa.RecordBatch:
            win = shared.value
            lens, hit, in_items, longest = match_block(b.column(1).to_pylist(), win)
            names = [sorted({str(win.ids[i]) for i in got if win.ids[i] is not None}) for got in in_items]
            found: list[list] = [[] for _ in names]
            for d, p, n, i, q in longest:
                found[d].append((p, n, None if win.ids[i] is None else str(win.ids[i]), q))
            found = [[dict(zip(("word", "length", "item", "item_word"), m, strict=True)) for m in outermost(f)] for f in found]
            starts = np.cumsum(lens + 1) - lens - 1
            edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).reshape(-1, 2)
            rows = np.searchsorted(starts, edges[:, 0], "right") - 1
            spans: list[list] = [[] for _ in names]
            for d, (s, e) in zip(rows.tolist(), edges.tolist(), strict=True):
                spans[d].append({"s": s - int(starts[d]), "e": e - int(starts[d])})
            n_hit = np.bincount(rows, edges[:, 1] - edges[:, 0], len(names)).astype(np.int64)
            out = pa.record_batch([b.column(0), pa.array(lens), pa.array(n_hit), pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(names, pa.list_(pa.string())), pa.array(found, pa.list_(match))], ["id", "n_words", "n_hit", "spans", "items", "matches"])
            return out.filter(pa.array(n_hit > 0)) if only_hit else out

        return by_blocks(rows, block, f"id {rows.dtypes[0][1]}, n_words long, n_hit long, spans array<struct<s:long,e:long>>, items array<string>, matches array<{_MATCH}>"), shared

    if passes == 1:
        out = searched(src, items, False)[0].drop("spans")
    else:
        keyed = src.select(row_key(F.col("id"), F.col("text")).alias("key"), "text")
        none = items.limit(0)
        counted, _ = searched(keyed, none, False)
        hits = []
        for i in range(passes):
            found, shared = searched(keyed, items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == i), True)
            hits.append(staged(found.dropDuplicates(["id"]), "bench-hits"))
            shared.destroy()
        every = functools.reduce(DataFrame.unionByName, hits)
        gathered = every.groupBy("id").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "matches")))
        covered = "aggregate(array_sort(spans), struct(0L as n, 0L as to), (a, x) -> struct(a.n + greatest(0L, x.e - greatest(x.s, a.to)) as n, greatest(a.to, x.e) as to)).n"
        gathered = staged(gathered.selectExpr("id as key", f"{covered} as n_hit", "array_sort(array_distinct(items)) as items", f"{_OUTERMOST} as matches"), "bench-gathered")
        size = gathered.agg(F.coalesce(F.sum(64 + 48 * F.size("matches") + 24 * F.size("items")), F.lit(0)).alias("n")).first().n
        slim = counted.select(F.col("id.id").alias("id"), F.col("id").alias("key"), "n_words")
        gathered = F.broadcast(gathered) if size <= broadcast_bytes else gathered
        out = slim.join(gathered.withColumnRenamed("key", "of"), F.col("key").eqNullSafe(F.col("of")), "left")
        out = out.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("matches", F.array().cast(f"array<{_MATCH}>")).alias("matches"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"), "matches")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.coalesce(F.array_max("matches.length"), F.lit(0)).alias("longest"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (SELECT item_id, least(10, len(w)) AS n, p, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS win
         FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
dw AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
occ AS (SELECT dw.doc_id, dw.p, dw.n, wins.item_id, wins.p AS ip FROM dw JOIN wins ON dw.win = wins.win AND dw.n = wins.n),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM occ)) GROUP BY doc_id),
runs AS (SELECT doc_id, n, p - row_number() OVER (PARTITION BY doc_id, item_id, n, ip - p ORDER BY p) AS run, item_id, ip - p AS shift FROM occ),
longest AS (SELECT doc_id, max(size) AS longest FROM (SELECT doc_id, count(*) + n - 1 AS size FROM runs GROUP BY doc_id, item_id, n, shift, run) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
       sha256(coalesce(its.items, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated, coalesce(longest.longest, 0) AS longest
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN longest USING (doc_id)
"""
