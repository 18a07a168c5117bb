"""Band join of items with the lines of other items whose unit price is near, by adaptive recursive partitioning.

Cents are floor(100 * x + 0.5) in doubles: p of an item's price, a of a line's amount;
u = floor((2a + q) / 2q) in exact integers, the line's unit price. An item pairs with every
line of another item_id with |u - p| <= w, w = max(10, floor(2p / 1000)).

1. Lines are folded where they are read: of each (u, item) of a chunk one row keeps the
   number of lines and the sum of their checksums; beside it stay only the lines that can be
   among some item's first `top`: at most `top` of a (u, item), at most 2 * top of a u. A
   hot item, sale or price so becomes a few rows a task, and no line's count is lost.
2. A histogram over floating buckets (the ten leading bits of a price: 28,673 buckets at
   most, whatever the input) gives the load of any price region: its items and the lines of
   the region and its borders. The driver splits the heaviest region again and again, at the
   bucket border that evens the load, until none is above the target. A region narrower than
   four bands isn't split by price any more, since its borders would be replicated more than
   they save: it is split as a grid, its lines by a hash into g parts, its items into h.
3. Lines go to each region whose band they reach (and to each of its h columns), items to
   their own region (and each of its g rows). A cell is one partition of at most
   `cell_rows` rows or so.
4. In a cell DuckDB range-joins the distinct prices with the price levels, takes an item's
   own lines off by an equality and range join, and picks the first lines from the nearest
   levels. Items of a grid get a part from each row of cells; the parts are added and the
   first lines merged by a grouping on the item.

So no pair is ever listed: the work follows items, lines and distinct prices in a band.

Defined results: lines null in sale_id, item_id, quantity or amount, of quantity 0, or with
an amount that isn't finite (or of 9e13 and more) never pair; repeated lines each count and
take a rank each; a null line_no sorts first and is written as nothing in the checksum. Items
null in price, without an id, or with such a price, get one row of rank 0, as do items
without pairs. Repeated item rows give their rows each. A negative quantity or amount is
computed with as any other number. Empty tables: no items give no rows, no lines only rank 0.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

TOP = 5
#: Stands for a null line_no between reading and writing.
_NONE = -(1 << 63)
_LINE = ["v", "item", "sale", "line", "n", "crc"]


def _cents(x: Column) -> Column:
    return F.when(F.abs(x) < 9e13, F.floor(F.lit(100.0) * x + F.lit(0.5)))


def _unit(a: Column, q: Column) -> Column:
    """floor((2a + q) / 2q), null for q = 0."""
    x, y = F.when(q < 0, -(2 * a + q)).otherwise(2 * a + q), F.nullif(F.abs(2 * q), F.lit(0).cast("long"))
    return F.call_function("div", x - F.pmod(x, y), y)


def unit_prices(lines: DataFrame) -> DataFrame:
    """v (the unit price), item, sale, line and crc of the lines that can pair."""
    q = lines["quantity"].cast("long")
    named = F.concat_ws(",", lines["sale_id"].cast("string"), F.coalesce(lines["line_no"].cast("string"), F.lit("")), lines["item_id"].cast("string"))
    out = lines.select(_unit(_cents(lines["amount"]), q).alias("v"), lines["item_id"].cast("long").alias("item"), lines["sale_id"].cast("long").alias("sale"), F.coalesce(lines["line_no"].cast("long"), F.lit(_NONE)).alias("line"), F.crc32(named).alias("crc"))
    return out.where("v is not null and item is not null and sale is not null")


def _fold(v: np.ndarray, item: np.ndarray, sale: np.ndarray, line: np.ndarray, crc: np.ndarray, top: int) -> pa.RecordBatch:
    """Lines -> for each (v, item) a row with its count and checksum sum on its first line, and the further lines (count 0) that can be among somebody's first `top`."""
    by = np.lexsort((line, sale, item, v))
    v, item, sale, line, crc = v[by], item[by], sale[by], line[by], crc[by]
    first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (item[1:] != item[:-1])]))
    counts = np.diff(np.append(first, len(v)))
    n, total = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
    n[first], total[first] = counts, np.add.reduceat(crc, first)
    nth = np.arange(len(v)) - np.repeat(first, counts)
    few = np.flatnonzero(nth < top)
    few = few[np.lexsort((item[few], line[few], sale[few], v[few]))]
    start = np.flatnonzero(np.concatenate([[True], v[few][1:] != v[few][:-1]]))
    rank = np.arange(len(few)) - np.repeat(start, np.diff(np.append(start, len(few))))
    keep = nth == 0
    keep[few[rank < 2 * top]] = True
    return pa.record_batch([pa.array(x[keep]) for x in (v, item, sale, line, n, total)], _LINE)


def _folded(batches: Iterator[pa.RecordBatch], top: int, chunk: int) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def out():
        return _fold(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(5)), top)

    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= chunk:
            yield out()
            held, rows = [], 0
    if held:
        yield out()


def _bucket(v: Column) -> Column:
    """The least price with the same ten leading bits; all negative ones are one bucket."""
    shift = F.greatest(F.length(F.bin(v)) - 10, F.lit(0))
    return F.when(v < 0, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift))


def _width(bucket: np.ndarray) -> np.ndarray:
    return np.array([1 << max(int(b).bit_length() - 10, 0) for b in bucket], np.int64)


def _band(p: np.ndarray) -> np.ndarray:
    return np.maximum(10, 2 * p // 1000)


class Regions:
    """Price regions of bounded load: lowest item price, lines' reach, and each region's grid of cells."""

    def __init__(self, bucket: np.ndarray, items: np.ndarray, lines: np.ndarray, target: int):
        by = np.argsort(bucket)
        bucket, items, lines = bucket[by], items[by], lines[by]
        top = bucket + _width(bucket) - 1
        at = np.flatnonzero(items > 0)
        si, sl = np.concatenate([[0], np.cumsum(items)]), np.concatenate([[0], np.cumsum(lines)])

        def loads(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Items of the buckets a to b, and lines that reach them."""
            low, high = np.where(bucket[a] < 0, -(1 << 62), bucket[a] - _band(bucket[a])), top[b] + _band(top[b])
            return si[b + 1] - si[a], sl[np.searchsorted(bucket, high, "right")] - sl[np.searchsorted(top, low, "left")]

        def entry(a: int, b: int) -> tuple[int, int, int]:
            i, x = loads(np.array([a]), np.array([b]))
            return -int(i[0] + x[0]), a, b

        heap, done = [entry(int(at[0]), int(at[-1]))] if len(at) else [], []
        while heap:
            load, a, b = heapq.heappop(heap)
            inner = at[(at >= a) & (at <= b)]
            if -load > target and len(inner) > 1:
                left, right = inner[:-1], inner[1:]
                wide = (top[left] - bucket[a] + 1 >= 4 * _band(top[left])) & (top[b] - bucket[right] + 1 >= 4 * _band(top[b : b + 1]))
                left, right = left[wide], right[wide]
                if len(left):
                    one, two = sum(loads(np.full(len(left), a), left)), sum(loads(right, np.full(len(right), b)))
                    best = int(np.argmin(np.maximum(one, two)))
                    if max(one[best], two[best]) < -load:
                        heapq.heappush(heap, entry(a, int(left[best])))
                        heapq.heappush(heap, entry(int(right[best]), b))
                        continue
            done.append((a, b))
        done.sort()
        a, b = (np.array(x, np.int64) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.low = np.where(bucket[a] < 0, -(1 << 62), bucket[a])
        self.reach_low, self.reach_high = self.low - _band(self.low), top[b] + _band(top[b])
        i, x = loads(a, b)
        over = i + x > target
        self.rows = np.where(over, np.maximum(1, -(-2 * x // target)), 1)  # parts of the lines
        self.cols = np.where(over, np.maximum(1, -(-2 * i // target)), 1)  # parts of the items
        cells = self.rows * self.cols
        self.base = np.cumsum(cells) - cells
        self.cells = int(cells.sum())

    def place_lines(self, u: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of a line, cell: each region it reaches, all columns of one grid row."""
        first, last = np.searchsorted(self.reach_high, u, "left"), np.searchsorted(self.reach_low, u, "right")
        which, region = _spread(first, np.maximum(last - first, 0))
        at, col = _spread(np.zeros(len(region), np.int64), self.cols[region])
        region, which = region[at], which[at]
        return which, self.base[region] + h[which] % self.rows[region] * self.cols[region] + col

    def place_items(self, p: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of an item, cell: its own region, all rows of one grid column."""
        region = np.searchsorted(self.low, p, "right") - 1
        at, row = _spread(np.zeros(len(p), np.int64), self.rows[region])
        region = region[at]
        return at, self.base[region] + row * self.cols[region] + h[at] % self.cols[region]


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, count[i] times: i and start[i], start[i] + 1, ..."""
    which = np.repeat(np.arange(len(count)), count)
    return which, start[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


def _hash(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(33)).astype(np.int64)


def _dealt(regions: Regions, lines: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v, item, sale = (b.column(i).to_numpy() for i in range(3))
                which, cell = regions.place_lines(v, _hash(item ^ _hash(sale))) if lines else regions.place_items(v, _hash(item))
                out = b.take(pa.array(which))
                yield pa.record_batch([pa.array(cell.astype(np.int32)), pa.array(np.full(len(cell), lines)), *out.columns], ["cell", "is_line", *_LINE])

    return run


#: In a cell: l has its lines, i its items (v is the price, n the number of equal rows).
_CELL = """
WITH lv AS (SELECT v AS u, sum(n)::BIGINT AS n, sum(crc)::BIGINT AS c FROM l GROUP BY v),
own AS (SELECT v AS u, item, sum(n)::BIGINT AS n, sum(crc)::BIGINT AS c FROM l GROUP BY v, item),
cand AS (SELECT v AS u, sale, line, item FROM (SELECT *, row_number() OVER (PARTITION BY v, item ORDER BY sale, line) AS k FROM l)
         WHERE k <= {top} QUALIFY row_number() OVER (PARTITION BY v ORDER BY sale, line, item) <= 2 * {top}),
full_levels AS (SELECT u FROM cand GROUP BY u HAVING count(*) = 2 * {top}),
pr AS (SELECT DISTINCT v AS p, v - greatest(10, 2 * v // 1000) AS lo, v + greatest(10, 2 * v // 1000) AS hi FROM i),
near AS MATERIALIZED (SELECT p, u, n, c, abs(u - p) AS gap FROM pr JOIN lv ON u >= lo AND u <= hi),
sums AS (SELECT p, sum(n)::BIGINT AS n, sum(n * gap)::BIGINT AS g, sum(c)::BIGINT AS c FROM near GROUP BY p),
-- A full level has `top` lines of others for any item: no farther one is needed.
used AS (SELECT p, u, gap FROM near LEFT JOIN full_levels AS f USING (u)
         QUALIFY coalesce(count(f.u) OVER (PARTITION BY p ORDER BY gap, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0),
firsts AS (SELECT * FROM (SELECT used.p, used.gap, u, sale, line, item, row_number() OVER (PARTITION BY used.p, item ORDER BY gap, u, sale, line) AS k FROM used JOIN cand USING (u))
           WHERE k <= {top} QUALIFY row_number() OVER (PARTITION BY p ORDER BY gap, u, sale, line, item) <= 2 * {top}),
mine AS (SELECT i.v AS p, i.item, sum(own.n)::BIGINT AS n, sum(own.n * abs(own.u - i.v))::BIGINT AS g, sum(own.c)::BIGINT AS c
         FROM i JOIN own ON own.item = i.item AND own.u >= i.v - greatest(10, 2 * i.v // 1000) AND own.u <= i.v + greatest(10, 2 * i.v // 1000) GROUP BY i.v, i.item),
best AS (SELECT p, item, list({{'gap': gap, 'u': u, 'sale': sale, 'line': line, 'other': other}} ORDER BY gap, u, sale, line, other) AS first
         FROM (SELECT f.p, i.item, f.gap, f.u, f.sale, f.line, f.item AS other FROM i JOIN firsts AS f ON f.p = i.v AND f.item <> i.item
               QUALIFY row_number() OVER (PARTITION BY f.p, i.item ORDER BY f.gap, f.u, f.sale, f.line, f.item) <= {top}) GROUP BY p, item)
SELECT i.item, i.v AS p, i.n AS times, coalesce(sums.n, 0) - coalesce(mine.n, 0) AS n_pairs, coalesce(sums.g, 0) - coalesce(mine.g, 0) AS gap_sum,
       coalesce(sums.c, 0) - coalesce(mine.c, 0) AS lines_crc, best.first
FROM i LEFT JOIN sums ON sums.p = i.v LEFT JOIN mine ON mine.p = i.v AND mine.item = i.item LEFT JOIN best ON best.p = i.v AND best.item = i.item
"""
_FIRST = "array<struct<gap:long,u:long,sale:long,line:long,other:long>>"
_PARTS = f"item long, p long, times long, n_pairs long, gap_sum long, lines_crc long, first {_FIRST}, parted boolean"


def _joined(regions: Regions, top: int):
    """A partition's cells, each joined by DuckDB."""
    parted = np.repeat(regions.rows > 1, regions.rows * regions.cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        every = pa.Table.from_batches(rows)
        cells, side = every["cell"].to_numpy(), every["is_line"].to_numpy()
        for cell in np.unique(cells).tolist():
            at = cells == cell
            con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB"})
            con.register("l", every.filter(pa.array(at & side)))
            con.register("i", every.filter(pa.array(at & ~side)))
            got = con.sql(_CELL.format(top=top)).to_arrow_table()
            con.close()
            first = pa.list_(pa.struct([(c, pa.int64()) for c in ("gap", "u", "sale", "line", "other")]))
            for b in got.to_batches(10_000):
                yield pa.record_batch([*(c.cast(pa.int64()) for c in b.columns[:6]), b.column(6).cast(first), pa.array(np.full(b.num_rows, parted[cell]))], [*got.schema.names, "parted"])

    return run


def near_prices(items: DataFrame, lines: DataFrame, top: int = TOP, cell_rows: int = 400_000, least_rows: int = 20_000, chunk: int = 1 << 20) -> DataFrame:
    """Per row of items its first `top` pairs: item_id, rank, gap, u, sale_id, line_no, line_item_id, and n_pairs, gap_sum, lines_crc over all of them."""
    spark = items.sparkSession
    folded = staged(unit_prices(lines).mapInArrow(lambda it: _folded(it, top, chunk), ", ".join(f"{c} long" for c in _LINE)), "band-lines")
    priced = items.select(items["item_id"].cast("long").alias("item"), _cents(items["price"]).alias("v")).groupBy("item", "v").agg(F.count(F.lit(1)).alias("n"))
    priced = staged(priced, "band-items")
    able = priced.where("item is not null and v is not null").select("v", "item", F.lit(0).cast("long").alias("sale"), F.lit(0).cast("long").alias("line"), "n", F.lit(0).cast("long").alias("crc"))

    counted = able.select(_bucket(F.col("v")).alias("b"), F.lit(1).alias("i"), F.lit(0).alias("l")).unionByName(folded.select(_bucket(F.col("v")).alias("b"), F.lit(0).alias("i"), F.lit(1).alias("l")))
    found = np.array([tuple(r) for r in counted.groupBy("b").agg(F.sum("i"), F.sum("l")).collect()], np.int64).reshape(-1, 3)
    target = max(least_rows, min(cell_rows, int(found[:, 1:].sum()) // (4 * spark.sparkContext.defaultParallelism)))
    regions = Regions(*found.T, target)

    none = F.lit(None).cast(_FIRST)
    out = priced.where("item is null or v is null").select("item", "v", F.col("n").alias("times"), *(F.lit(0).cast("long").alias(c) for c in ("n_pairs", "gap_sum", "lines_crc")), none.alias("first"))
    if regions.cells:
        schema = "cell int, is_line boolean, " + ", ".join(f"{c} long" for c in _LINE)
        dealt = folded.select(_LINE).mapInArrow(_dealt(regions, True), schema).unionByName(able.mapInArrow(_dealt(regions, False), schema))
        parts = dealt.repartitionById(regions.cells, "cell").mapInArrow(_joined(regions, top), _PARTS)
        if (regions.rows > 1).any():
            parts = staged(parts, "band-parts")
            merged = F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, top)
            sums = [F.sum(c).alias(c) for c in ("n_pairs", "gap_sum", "lines_crc")]
            parts = parts.where("not parted").drop("parted").unionByName(parts.where("parted").groupBy("item", "p").agg(F.first("times").alias("times"), *sums, merged.alias("first")).select(*parts.columns[:-1]))
        else:
            parts = parts.drop("parted")
        out = parts.unionByName(out.withColumnRenamed("v", "p"))
    rows = out.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("item", "n_pairs", "gap_sum", "lines_crc", F.posexplode_outer("first").alias("at", "x"))
    line = F.when(F.col("x.line") != _NONE, F.col("x.line"))
    return rows.select(F.col("item").alias("item_id"), F.coalesce(F.col("at") + 1, F.lit(0)).cast("int").alias("rank"), F.col("x.gap").alias("gap"), F.col("x.u").alias("u"), F.col("x.sale").alias("sale_id"), line.alias("line_no"), F.col("x.other").alias("line_item_id"), "n_pairs", "gap_sum", "lines_crc")


def op12_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_prices(table(spark, sf_dir, "items"), table(spark, sf_dir, "sale_lines"))


#: CRC-32 of an ASCII text, byte by byte, over the 256 remainders of its polynomial.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(s, ''), lambda ch: ascii(ch)::BIGINT)),
        lambda r, x: xor(r >> 8, t[(xor(r, x) & 255) + 1]))"""
ORACLE_SQL = f"""
WITH RECURSIVE steps AS (SELECT range AS i, range::BIGINT AS r, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, k + 1 FROM steps WHERE k < 8),
tab AS (SELECT list(r ORDER BY i) AS t FROM steps WHERE k = 8),
l0 AS (SELECT sale_id, line_no, item_id, quantity::BIGINT AS q, CASE WHEN abs(amount) < 9e13 THEN floor(100 * amount + 0.5)::BIGINT END AS a,
              sale_id || ',' || coalesce(line_no::VARCHAR, '') || ',' || item_id AS s
       FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity <> 0),
l1 AS (SELECT *, CASE WHEN q < 0 THEN -(2 * a + q) ELSE 2 * a + q END AS x, abs(2 * q) AS y FROM l0 WHERE a IS NOT NULL),
l AS (SELECT sale_id, line_no, item_id, (x - ((x % y) + y) % y) // y AS u, xor({_CRC}, 4294967295) AS crc FROM l1, tab),
i AS (SELECT row_number() OVER () AS rn, item_id, CASE WHEN abs(price) < 9e13 THEN floor(100 * price + 0.5)::BIGINT END AS p FROM items),
pairs AS (SELECT rn, abs(u - p) AS gap, u, sale_id, line_no, l.item_id AS line_item_id, crc
          FROM i JOIN l ON u >= p - greatest(10, 2 * p // 1000) AND u <= p + greatest(10, 2 * p // 1000) AND i.item_id <> l.item_id),
sums AS (SELECT rn, count(*) AS n_pairs, sum(gap)::BIGINT AS gap_sum, sum(crc)::BIGINT AS lines_crc FROM pairs GROUP BY rn),
ranked AS (SELECT rn, gap, u, sale_id, line_no, line_item_id, row_number() OVER (PARTITION BY rn ORDER BY gap, u, sale_id, line_no NULLS FIRST, line_item_id) AS rank FROM pairs QUALIFY rank <= {TOP})
SELECT i.item_id, coalesce(rank, 0)::INTEGER AS rank, gap, u, ranked.sale_id, line_no::BIGINT AS line_no, line_item_id,
       coalesce(n_pairs, 0) AS n_pairs, coalesce(gap_sum, 0) AS gap_sum, coalesce(lines_crc, 0) AS lines_crc
FROM i LEFT JOIN sums USING (rn) LEFT JOIN ranked USING (rn)
"""
