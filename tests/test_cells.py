"""Exact neighbour search by cells: pruning, bounds on what is sent, and the index on disk."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import cells, neighbours


def _vectors(n, clusters, dim=8, seed=3):
    r = np.random.default_rng(seed)
    return (r.integers(0, clusters, n)[:, None] * 50 + r.normal(size=(n, dim))).astype(np.float32)


def _brute(v, k, queries=None):
    out = {}
    for i in range(len(v)) if queries is None else queries:
        d = ((v[i].astype(np.float64) - v.astype(np.float64)) ** 2).sum(1)
        out[i] = sorted((round(float(x), 6), j) for j, x in enumerate(d))[:k]
    return out


def _frame(spark, v, at=None):
    return spark.createDataFrame([(int(i), [float(x) for x in v[i]]) for i in (range(len(v)) if at is None else at)], "vec_id long, embedding array<float>")


def _got(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append((round(r.d, 6), r.nid))
    return out


@pytest.mark.parametrize("k,partitions", [(1, 1), (7, 4), (40, 16)])
def test_nearest_equals_brute_force_with_copies(spark, k, partitions):
    v = _vectors(400, 6)
    v[100:230] = v[0]  # a third of all rows are copies
    got = neighbours.nearest(_frame(spark, v).repartition(partitions), k, block_bytes=640)
    assert _got(got) == _brute(v, k)


def test_clustered_vectors_skip_cell_pairs_and_bound_what_is_sent(spark):
    v = _vectors(600, 10)
    src = neighbours._source(_frame(spark, v), "vec_id", "embedding")
    pivots = cells.choose_pivots(src)
    packed = cells.blocks(src, pivots)
    found, plan = cells.search(packed, packed, pivots, 5)
    compared, every = plan.pairs
    assert compared < every / 4
    assert plan.sent().max() <= len(plan.needed) and plan.sent().sum() < len(plan.needed) * len(pivots) / 2
    assert found.groupBy("id").count().where("count <> 5").isEmpty()  # as many rows a query as asked for, whatever the groups
    within = cells.search(packed, packed, pivots, 500, 0.05)[1]
    assert within.pairs[0] < every / 2  # k is beyond a cluster, the threshold isn't


def test_near_duplicates_equal_the_rule_over_the_k_nearest(spark):
    v = _vectors(300, 5, dim=4)
    v[50:90] = v[7]
    v[120] = v[3] + np.float32(0.05)
    near = _brute(v, 60)
    got = {r.vec_id: (round(r.min_neighbor_distance, 6), r.repeat_count, r.representative) for r in neighbours.near_duplicates(_frame(spark, v), 0.05, 60).collect()}
    for i, rows in near.items():
        others = [(d, j) for d, j in rows if j != i]
        close = [j for d, j in others if d < 0.05]
        assert got[i] == (min(others)[0], len(close), min(i, *close) if close else None)


def test_index_is_searched_after_an_append_and_reads_few_cells(spark, tmp_path):
    v, path = _vectors(500, 8), str(tmp_path / "index")
    neighbours.save_index(_frame(spark, v, range(0, 300)), path)
    neighbours.append_index(_frame(spark, v, range(300, 500)), path)
    asked = [i for i in range(500) if i % 20 == 0]
    assert _got(neighbours.search_index(_frame(spark, v, asked), path, 10)) == _brute(v, 10, asked)
    found = neighbours.search_index(_frame(spark, v, asked[:1]), path, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "IN (" in plan.upper().replace("INSET", "IN (")
    read = {f.split("cell=")[1].split("/")[0] for f in spark.read.parquet(f"{path}/cells").inputFiles()}
    stored = spark.read.parquet(f"{path}/cells")
    pivots = neighbours._centres(spark, path)
    one = cells.blocks(neighbours._source(_frame(spark, v, asked[:1]), "vec_id", "embedding"), pivots)
    assert cells.search(one, stored, pivots, 3)[1].needed.sum() <= len(read) / 2
    back = {r.vec_id: list(r.embedding) for r in neighbours.load_index(spark, path).collect()}
    assert back == {i: v[i].tolist() for i in range(500)}


def test_search_of_nothing_and_in_nothing(spark, tmp_path):
    v, path = _vectors(5, 1), str(tmp_path / "index")
    neighbours.save_index(_frame(spark, v), path)
    assert neighbours.search_index(_frame(spark, v).where(F.lit(False)), path, 2).count() == 0
    assert _got(neighbours.search_index(_frame(spark, v, [1]), path, 50)) == _brute(v, 5, [1])


@pytest.mark.parametrize("kind", [int, str])
def test_best_of_chunks_equals_a_full_sort_with_ties(kind):
    r, n, k = np.random.default_rng(8), 2 * cells.CHUNK + 7, 5
    best, seen = cells._Best(n, k), {}
    for _ in range(30):
        for chunk in range(3):
            q = r.integers(0, min(cells.CHUNK, n - chunk * cells.CHUNK), 2500)
            d, ids = r.integers(0, 6, len(q)).astype(float), r.permutation(10**6)[: len(q)]
            nid = ids if kind is int else np.array([f"n{i}" for i in ids], object)
            best.add(chunk, q, d, nid)
            for x in zip((chunk * cells.CHUNK + q).tolist(), d.tolist(), nid.tolist(), strict=True):
                seen.setdefault(x[0], []).append(x[1:])
    got = {}
    for chunk in range(3):
        for q, d, nid, rank in zip(*(x.tolist() for x in best.merge(chunk)), strict=True):
            assert rank == len(got.setdefault(chunk * cells.CHUNK + q, []))
            got[chunk * cells.CHUNK + q].append((d, nid))
    assert got == {q: sorted(rows)[:k] for q, rows in seen.items()}
    assert all(best.kth[q] == rows[-1][0] for q, rows in got.items() if len(rows) == k)


def test_a_merge_copies_a_chunk_and_not_all_pairs_of_a_task():
    chunks, k, r = 16, 100, np.random.default_rng(2)
    best = cells._Best(chunks * cells.CHUNK, k)
    q, d, nid = np.repeat(np.arange(cells.CHUNK), k), r.random(k * cells.CHUNK), np.arange(k * cells.CHUNK)
    tracemalloc.start()
    for chunk in range(chunks):
        best.add(chunk, q, d + chunk, nid + chunk)
        best.add(chunk, q[:5000], d[:5000], nid[:5000])
        best.merge(chunk)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 1.4 * held, (peak, held)


def test_within_a_threshold_only_rows_below_it_and_the_nearest_other_are_kept():
    d = np.random.default_rng(1).random((50, 3000)) + 0.9
    d[7] = 3.0
    d[7, :2] = 0.0, 2.5
    limit = cells._limits(d, np.full(50, np.inf), np.zeros(50), 500, 0.95)
    assert (np.sort(d, axis=1)[:, 1] <= limit).all() and limit[7] == 2.5
    assert (np.delete(limit, 7) == 0.95).all()  # not the 500th nearest
