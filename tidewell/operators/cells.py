"""Exact nearest-neighbour search by cells of a metric space (squared L2).

Vectors belong to the nearest of a bounded number of pivots. Of each cell only its size and the
least and greatest distance of a member to its pivot are known to the driver. With the distances
between pivots they bound, by the triangle inequality, how near any two cells can be and how far
the k-th neighbour of any query in a cell can be at most; cell pairs that can't matter are never
shipped.

Queries are dealt to groups of neighbouring cells, each one task of bounded bytes. Every block of
data goes to the groups that may need it, nearest first; so a vector is sent once as a query and
at most as many times as there are groups as data. A task keeps the best k of each of its queries
while its blocks stream by, and skips, by the same inequalities on single queries, what can't
improve them. A query's neighbours are complete in its one task: nothing is merged after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import small_batches

#: Pivots at most, and bytes of all pivots together.
MAX_PIVOTS, PIVOT_BYTES = 1024, 8 << 20
BLOCK = "cell int, n int, low double, high double, ids array<{kind}>, vectors binary"


def vectors(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, as float32."""
    flat = column.flatten()
    width = len(flat) // max(1, len(column))
    if len(column) and (pa.compute.list_value_length(column).to_numpy() != width).any():
        raise ValueError("vectors differ in length")
    return flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), width)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all of b, up to rounding."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0))


def choose_pivots(src: DataFrame, most: int = MAX_PIVOTS) -> np.ndarray:
    """About sqrt(n) distinct vectors of src (id, v) in hash order, bounded in number and bytes."""
    size = src.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    n = max(1, min(most, PIVOT_BYTES // (4 * (size.dim or 1)), int(size.n**0.5)))
    rows = src.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(n).select("v").collect()
    return np.unique(np.array([r.v for r in rows], np.float32), axis=0) if rows else np.zeros((0, 0), np.float32)


def _assign(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cell, far = np.empty(len(v), np.int32), np.empty(len(v))
    for at in range(0, len(v), 2048):
        d = distances(v[at : at + 2048], pivots)
        cell[at : at + 2048] = best = d.argmin(1)
        far[at : at + 2048] = d[np.arange(len(best)), best]
    return cell, far


def blocks(src: DataFrame, pivots: np.ndarray, block_bytes: int = 1 << 20) -> DataFrame:
    """src (id, v) as packed blocks of one cell each: cell, n, low and high (distance to the pivot), ids, vectors. Packed where the rows are: nothing is shuffled."""
    kind = dict(src.dtypes)["id"]
    shared = src.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size > 32 << 20:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        ids, v = t["id"].combine_chunks(), vectors(t["v"].combine_chunks())
        cell, far = _assign(v, shared.value)
        by = np.lexsort((far, cell))
        cell, far, v, ids = cell[by], far[by], v[by], ids.take(pa.array(by))
        most = max(1, block_bytes // max(1, 4 * v.shape[1]))
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        starts = np.concatenate([np.arange(a, z, most) for a, z in zip(first, np.append(first[1:], len(cell)), strict=True)])
        ends = np.append(starts[1:], len(cell))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(cell)), pa.int32()), ids)
        body = [v[a:z].tobytes() for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
        return pa.record_batch([pa.array(cell[starts]), pa.array((ends - starts).astype(np.int32)), pa.array(far[starts]), pa.array(far[ends - 1]), lists, pa.array(body, pa.binary())], ["cell", "n", "low", "high", "ids", "vectors"])

    return src.mapInArrow(run, BLOCK.format(kind=kind))


@dataclass
class Stats:
    """Per cell: members, least and greatest distance to the pivot."""

    n: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, table: DataFrame, cells: int) -> Stats:
        """From blocks; of stored ones only these columns are read."""
        out = cls(np.zeros(cells, np.int64), np.full(cells, np.inf), np.zeros(cells))
        for r in table.groupBy("cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect():  # a row a cell
            out.n[r.cell], out.low[r.cell], out.high[r.cell] = r.n, r.low, r.high
        return out


@dataclass
class Plan:
    """Which group needs which cell, nearest cells first, and where each cell's queries go."""

    between: np.ndarray  # least distance of two cells' members: query cell, data cell
    needed: np.ndarray  # group, cell
    order: np.ndarray  # least distance of a group's queries to a cell
    first: np.ndarray  # first group of a cell's queries
    parts: np.ndarray  # groups they are split over
    pairs: tuple[int, int]  # pairs of cells that are compared, and all pairs

    def sent(self) -> np.ndarray:
        """How many groups each cell is sent to."""
        return self.needed.sum(0)


def plan(pivots: np.ndarray, asked: Stats, data: Stats, k: int, within: float | None, group_rows: int, least_groups: int) -> Plan:
    """within: beyond the nearest other row, only neighbours of a squared distance below this matter."""
    c = distances(pivots, pivots)
    if not len(c):
        return Plan(c, np.zeros((0, 0), bool), c, np.zeros(0, np.int64), np.zeros(0, np.int64), (0, 0))
    tol = 1e-6 * (1 + np.abs(pivots).max(initial=0) * max(1, pivots.shape[1]) ** 0.5)
    live_q, live_d = asked.n > 0, data.n > 0
    lower = np.maximum.reduce([np.zeros_like(c), c - asked.high[:, None] - data.high[None, :], np.where(live_d, data.low, 0)[None, :] - c - asked.high[:, None]])

    def reach(rank: int) -> np.ndarray:
        """How far the rank-th nearest row of any query of a cell can be: cells by their farthest member until they hold so many."""
        farthest = np.where(live_d[None, :], asked.high[:, None] + c + data.high[None, :], np.inf)
        by = np.argsort(farthest, axis=1)
        enough = np.cumsum(data.n[by], axis=1) >= rank
        at = np.where(enough.any(1), enough.argmax(1), 0)
        return np.where(enough.any(1), farthest[np.arange(len(by)), by[np.arange(len(by)), at]], np.inf)

    bound = reach(k)
    if within is not None:
        bound = np.minimum(bound, np.maximum(within**0.5, reach(2)))
    pair_needed = (lower <= bound[:, None] + tol) & live_q[:, None] & live_d[None, :]

    # A tour through neighbouring pivots, cut into groups of about group_rows queries; a larger cell is split over several.
    left, tour = set(np.flatnonzero(live_q).tolist()), []
    while left:
        d = c[tour[-1]] if tour else np.zeros(len(c))
        nxt = min(left, key=lambda i: (d[i], i))
        tour.append(nxt)
        left.remove(nxt)
    rows = max(1, min(group_rows, -(-int(asked.n.sum()) // max(1, least_groups))))
    first, parts, members, filled = np.zeros(len(c), np.int64), np.ones(len(c), np.int64), [], 0
    for cell in tour:
        n = int(asked.n[cell])
        if n > rows:
            parts[cell], first[cell] = -(-n // rows), len(members)
            members += [[cell] for _ in range(int(parts[cell]))]
            filled = rows
        else:
            if not members or filled + n > rows:
                members.append([])
                filled = 0
            first[cell] = len(members) - 1
            members[-1].append(cell)
            filled += n
    needed = np.array([pair_needed[m].any(0) for m in members]).reshape(len(members), len(c))
    order = np.array([lower[m].min(0) for m in members]).reshape(len(members), len(c))
    return Plan(lower, needed, order, first, parts, (int(pair_needed.sum()), int(live_q.sum() * live_d.sum())))


#: Queries whose best are kept, merged and returned together.
CHUNK = 1024


def _values(ids: pa.Array) -> np.ndarray:
    """Ids as numbers, or as objects of any sortable type."""
    if pa.types.is_integer(ids.type) and not ids.null_count:
        return ids.to_numpy(zero_copy_only=False)
    out = np.empty(len(ids), object)
    out[:] = ids.to_pylist()
    return out


def _ordered(q: np.ndarray, d: np.ndarray, nid: np.ndarray) -> np.ndarray:
    """Order by q, d and nid. Only rows that agree in q and d are sorted by nid."""
    by = np.argsort(d)
    by = by[np.argsort(q[by], kind="stable")]  # a radix sort, q being 16 bits wide
    same = (q[by[1:]] == q[by[:-1]]) & (d[by[1:]] == d[by[:-1]])
    if same.any():
        at = np.flatnonzero(np.append(same, False) | np.append(False, same))
        tied = by[at]
        code = pd.factorize(nid[tied], sort=True)[0]
        by[at] = tied[np.lexsort((np.where(code < 0, len(code), code), d[tied], q[tied]))]
    return by


class _Best:
    """The k best (distance, id) of each query of a task, by chunks of queries, so that what a merge copies is bounded by a chunk and not by the task."""

    def __init__(self, queries: int, k: int):
        self.k, self.kth, self.second = k, np.full(queries, np.inf), np.full(queries, np.inf)
        self.parts: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(0, queries, CHUNK)]
        self.waiting = [0] * len(self.parts)
        self.held = [0] * len(self.parts)

    def add(self, chunk: int, q: np.ndarray, d: np.ndarray, nid: np.ndarray) -> None:
        """More pairs of one chunk; q counts from the chunk's first query."""
        self.parts[chunk].append((q.astype(np.uint16), d, nid))
        self.waiting[chunk] += len(q)
        if self.waiting[chunk] > max(4096, self.held[chunk] // 2):
            self.merge(chunk)

    def merge(self, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """q (from the chunk's first query), d, nid and rank (from 0) of the chunk's best, in order."""
        parts = self.parts[chunk]
        if not parts:
            return np.zeros(0, np.uint16), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, d, nid = (np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*parts, strict=True))
        if self.waiting[chunk]:
            by = _ordered(q, d, nid)
            q, d, nid = q[by], d[by], nid[by]
        n = np.bincount(q)
        rank = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
        if self.waiting[chunk]:
            at = chunk * CHUNK + q.astype(np.int64)
            self.second[at[rank == 1]] = d[rank == 1]
            self.kth[at[rank == self.k - 1]] = d[rank == self.k - 1]
            keep = rank < self.k
            q, d, nid, rank = q[keep], d[keep], nid[keep], rank[keep]
            self.parts[chunk], self.waiting[chunk], self.held[chunk] = [(q, d, nid)], 0, len(q)
        return q, d, nid, rank

    def drop(self, chunk: int) -> None:
        self.parts[chunk], self.waiting[chunk] = [], 0


def _limits(d: np.ndarray, limit: np.ndarray, slack: np.ndarray, k: int, within: float | None) -> np.ndarray:
    """limit, lowered where these distances alone show that fewer matter: the k nearest, and with within those nearer than it and the nearest other row."""
    for rank, floor in [(k, 0.0), *([] if within is None else [(min(k, 2), within)])]:
        if d.shape[1] <= rank:
            continue
        open_ = np.flatnonzero(limit > floor)
        open_ = open_[np.count_nonzero(d[open_] <= (limit + slack)[open_, None], axis=1) > rank]
        if len(open_):
            near = np.partition(d[open_], rank - 1, axis=1)[:, rank - 1] + slack[open_]
            limit[open_] = np.minimum(limit[open_], np.maximum(floor, near))
    return limit


def _exact(q: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs, each computed alone, so that equal pairs give equal numbers."""
    out = np.empty(len(i))
    step = max(1, (1 << 19) // max(1, q.shape[1]))
    for at in range(0, len(i), step):
        diff = q[i[at : at + step]] - m[j[at : at + step]]
        out[at : at + step] = np.einsum("ij,ij->i", diff, diff)
    return out


def search(asked: DataFrame, data: DataFrame, pivots: np.ndarray, k: int, within: float | None = None, fold=None, schema: str | None = None, group_bytes: int = 32 << 20, list_bytes: int = 96 << 20) -> tuple[DataFrame, Plan]:
    """id, nid, d, rank of the k nearest data rows of each query, and the plan. asked and data are blocks over the same pivots. fold: maps a task's rows (id, nid, d, rank; pandas) to what is returned instead, with its schema."""
    spark = asked.sparkSession
    small_batches(spark)
    kind, nkind = (dict(x.dtypes)["ids"].removeprefix("array<").removesuffix(">") for x in (asked, data))
    width = max(1, pivots.shape[1])
    rows = max(1, min(group_bytes // (4 * width), list_bytes // (24 * k)))
    p = plan(pivots, Stats.of(asked, len(pivots)), Stats.of(data, len(pivots)), k, within, rows, 2 * spark.sparkContext.defaultParallelism)
    groups = len(p.needed)
    columns = ["group", "is_data", "near", "cell", "low", "high", "ids", "nids", "vectors"]
    none = {"ids": F.lit(None).cast(f"array<{kind}>"), "nids": F.lit(None).cast(f"array<{nkind}>")}
    empty = schema or f"id {kind}, nid {nkind}, d double, rank int"
    if not groups:
        return spark.createDataFrame([], empty), p

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries -> their groups; a block of a cell that is split goes on in parts."""
        for b in batches:
            for r in range(b.num_rows):
                cell, n = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                parts = int(p.parts[cell])
                ids, v = b.column(4)[r].values, np.frombuffer(b.column(5)[r].as_buffer(), np.float32).reshape(n, -1)
                turn = (np.arange(n) + np.frombuffer(v[:1].tobytes(), np.uint8).sum()) % parts
                for part in np.unique(turn).tolist():
                    at = np.flatnonzero(turn == part)
                    yield pa.record_batch([pa.array([int(p.first[cell]) + part], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), ids.take(pa.array(at))), pa.array([v[at].tobytes()], pa.binary())], ["group", "ids", "vectors"])

    sides = asked.mapInArrow(dealt, f"group int, ids array<{kind}>, vectors binary").select("group", F.lit(False).alias("is_data"), F.lit(0.0).alias("near"), F.lit(-1).alias("cell"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), "ids", none["nids"].alias("nids"), "vectors")
    g, cells = np.nonzero(p.needed)
    wants = pd.DataFrame({"cell": cells.astype(np.int32), "group": g.astype(np.int32), "near": p.order[g, cells]})
    lists = [(int(c), [(int(x), float(y)) for x, y in zip(part.group, part.near, strict=True)]) for c, part in wants.groupby("cell")]
    need = spark.createDataFrame(lists, "cell int, wants array<struct<group:int,near:double>>")
    sent = data.where(F.col("cell").isin([c for c, _ in lists])) if len(lists) < len(pivots) else data
    sent = sent.join(F.broadcast(need) if len(wants) * 16 <= 32 << 20 else need, "cell").withColumn("want", F.explode("wants"))
    sides = sides.unionByName(sent.select(F.col("want.group").alias("group"), F.lit(True).alias("is_data"), F.col("want.near").alias("near"), "cell", "low", "high", none["ids"].alias("ids"), F.col("ids").alias("nids"), "vectors"))
    tol = 1e-6 * (1 + np.abs(pivots).max(initial=0) * width**0.5)
    shared = spark.sparkContext.broadcast(pivots)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One group: its queries come first, then its data, nearest first."""
        ids, parts, held, best, state = [], [], [], None, {}

        def begin():
            q = np.concatenate(parts).astype(np.float64)
            state.update(q=q, norms=(q**2).sum(1), to={})
            return _Best(len(q), k)

        def compare():
            cell, low, high = held[0][0], min(h[1] for h in held), max(h[2] for h in held)
            m = np.concatenate([h[4] for h in held]).astype(np.float64)
            nids = np.concatenate([_values(h[3]) for h in held])
            q, pivot, norms, mine = state["q"], shared.value[cell], state["norms"], (m**2).sum(1)
            to = distances(q, pivot[None, :])[:, 0]
            bound = best.kth if within is None else np.minimum(best.kth, np.maximum(within, best.second))
            live = np.flatnonzero(np.maximum(to - high, low - to) <= np.sqrt(bound) + tol)
            for chunk in np.unique(live // CHUNK).tolist():
                some = live[live // CHUNK == chunk]
                d = q[some] @ m.T
                d *= -2
                d += norms[some][:, None]
                d += mine
                slack = 1e-9 * (norms[some] + mine.max() + 1)
                limit = _limits(d, bound[some], slack, k, within)
                i, j = np.nonzero(d <= (limit + slack)[:, None])
                if len(i):
                    best.add(chunk, some[i] - chunk * CHUNK, _exact(q, m, some[i], j), nids[j])
            held.clear()

        for b in batches:
            b = dict(zip(b.schema.names, b.columns, strict=True))
            for r in range(len(b["group"])):
                v = np.frombuffer(b["vectors"][r].as_buffer(), np.float32).reshape(-1, width)
                if not b["is_data"][r].as_py():
                    ids.append(b["ids"][r].values)
                    parts.append(v)
                    continue
                if not parts:
                    return  # a part of a split cell that got no queries
                if best is None:
                    best = begin()
                cell = b["cell"][r].as_py()
                if held and (held[0][0] != cell or sum(len(h[4]) for h in held) >= 1024):
                    compare()
                held.append((cell, b["low"][r].as_py(), b["high"][r].as_py(), b["nids"][r].values, v))
        if held:
            compare()
        if best is None:
            if not parts:
                return
            best = begin()
        names = pa.concat_arrays(ids)
        ids, parts = [], []
        state.clear()
        for chunk, at in enumerate(range(0, len(names), CHUNK)):
            q, d, nid, rank = best.merge(chunk)
            best.drop(chunk)
            rank = (rank + 1).astype(np.int32)
            mine = names.slice(at, CHUNK)
            if fold:
                rows = pd.DataFrame({"id": mine.take(pa.array(q)).to_pandas(), "nid": nid, "d": d, "rank": rank})
                yield pa.RecordBatch.from_pandas(fold(rows, mine.to_pandas()), preserve_index=False, schema=arrow)
                continue
            for a in range(0, len(q), 50_000):
                some = slice(a, a + 50_000)
                yield pa.record_batch([mine.take(pa.array(q[some])), pa.array(nid[some], nid_type), pa.array(d[some]), pa.array(rank[some])], ["id", "nid", "d", "rank"])

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark.createDataFrame([], empty).schema)
    nid_type = to_arrow_schema(data.select(F.explode("ids").alias("nid")).schema).field("nid").type
    out = sides.select(columns).repartitionById(groups, "group").sortWithinPartitions("group", "is_data", "near", "cell").mapInArrow(searched, empty)
    return out, p
