"""op11 to op13 against plain restatements, with nulls, ties, repeats, long texts, empty tables and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import band_join, lexical_search, minhash_dedup
from tidewell.llm.jaccard_join import shingle_sets

SF = "/root/testdata/sf0.001"


def _near_prices(items, lines, top=5):
    def cents(x):
        return None if x is None or not abs(x) < 9e13 else math.floor(100 * x + 0.5)

    good = []
    for sale, no, item, q, amount in lines:
        a = cents(amount)
        if None not in (sale, item, q, a) and q:
            x = (2 * a + q, 2 * q)
            good.append((x[0] // x[1], sale, no, item, zlib.crc32(f"{sale},{'' if no is None else no},{item}".encode())))
    out = []
    for item, price in items:
        p = cents(price)
        got = [] if p is None or item is None else [(abs(u - p), u, s, n, i, c) for u, s, n, i, c in good if i != item and (abs(u - p) <= 10 or 1000 * abs(u - p) <= 2 * p)]
        got.sort(key=lambda r: (r[:3], -(1 << 63) if r[3] is None else r[3], r[4]))
        sums = (len(got), sum(r[0] for r in got), sum(r[5] for r in got))
        out += [(item, k, *r[:5], *sums) for k, r in enumerate(got[:top], 1)] or [(item, 0, None, None, None, None, None, *sums)]
    return sorted(out, key=str)


COLS = ["item_id", "rank", "gap", "u", "sale_id", "line_no", "line_item_id", "n_pairs", "gap_sum", "lines_crc"]


def _tables(spark, items, lines):
    i = spark.createDataFrame(items, "item_id long, price double").withColumns({"v": F.lit("x"), "n": F.lit(1), "cell": F.lit(0)})
    x = spark.createDataFrame(lines, "sale_id long, line_no int, item_id long, quantity int, amount double").withColumns({"crc": F.lit("y"), "is_line": F.lit(True), "price": F.lit(1.0)})
    return i, x


@pytest.mark.parametrize("limits", [{}, {"cell_rows": 60, "least_rows": 10, "chunk": 37}, {"cell_rows": 7, "least_rows": 3, "chunk": 500}])
def test_band_join_equals_brute_force(spark, limits):
    r = random.Random(5)
    items = [(n, r.choice([5.0, 5.03, round(r.uniform(2, 400), 2)])) for n in range(60)]
    items += [(61, None), (None, 5.0), (62, float("nan")), (63, 1e15), (64, -3.0), (65, 900.0), (5, 5.0), (5, 5.0), (66, 0.0)]
    lines = []
    for s in range(400):
        item = 7 if s % 3 == 0 else r.randrange(60)  # a third of the lines are of one item
        q = r.choice([1, 2, 3, 7])
        lines.append((s // 3, r.choice([1, 2]), item, q, round(r.choice([5.0, 5.0, 5.02, r.uniform(2, 400)]) * q, 2)))
    lines += lines[:40] + [(None, 1, 3, 1, 5.0), (9, None, 3, 1, 5.0), (9, 1, None, 1, 5.0), (9, 1, 3, 0, 5.0), (9, 1, 3, None, 5.0), (9, 1, 3, 1, None), (9, 1, 3, 1, float("nan")), (9, 1, 3, -1, 3.0), (9, 1, 3, 2, -6.01), (9, 1, 4, 1, float("inf"))]
    got = [tuple(x) for x in band_join.near_prices(*_tables(spark, items, lines), **limits).select(COLS).collect()]
    assert sorted(got, key=str) == _near_prices(items, lines)


def test_band_join_of_empty_tables(spark):
    assert band_join.near_prices(*_tables(spark, [], [(1, 1, 1, 1, 5.0)])).count() == 0
    (row,) = band_join.near_prices(*_tables(spark, [(1, 5.0)], [])).select(COLS).collect()
    assert tuple(row) == (1, 0, None, None, None, None, None, 0, 0, 0)


def test_regions_bound_their_load_and_split_hot_values_as_grids():
    bucket = np.array([300, 500, 501, 800, 4000], np.int64)
    items, lines = np.array([10, 400, 10, 10, 10], np.int64), np.array([10, 9000, 10, 10, 500], np.int64)
    r = band_join.Regions(bucket, items, lines, 1000)
    assert len(r.low) == 2 and r.rows.max() >= 9000 // 1000 and r.cells == int((r.rows * r.cols).sum())
    u = np.repeat(500, 9000)
    _, cell = r.place_lines(u, np.arange(9000))
    assert np.bincount(cell).max() <= 1000
    _, at = r.place_items(np.repeat(500, 400), np.arange(400))
    assert set(at.tolist()) == set(cell.tolist())  # every part of the items meets every part of the lines


def _search(docs, items, k=10):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    bags = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in {(i, t) for i, t in items}:
        q, found = Counter(terms(text)), []
        for at, (d, b) in enumerate(bags):
            m = 25 + (75 * sum(b.values()) * n_docs) // total if total else 0
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t, c in q.items() if b[t])
            if s > 0:
                found.append((-s, (0, 0) if d is None else (1, d), at))
        out += [(item, rank, bags[at][0], -s) for rank, (s, _, at) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [{}, {"max_item_bytes": 40, "block_docs": 7}])
def test_search_equals_brute_force(spark, limits):
    r = random.Random(3)
    voc = ["Tide", "well", "ÄRA", "ära", "x1", "the", "of", "naïve", "日本", "İ"]
    docs = [(i, " ".join(r.choices(voc, k=r.randrange(1, 30)))) for i in range(80)]
    docs += [(200, None), (201, ""), (202, "?! --"), (None, "tide well"), (None, "tide well"), (5, "tide tide tide"), (203, "well " * 30_000), *[(300 + i, "x1 the-of") for i in range(30)]]
    items = [(1, "TIDE tide well"), (1, "x1"), (1, "x1"), (2, None), (3, ""), (4, "absent words"), (None, "日本 the of"), (6, "ÄRA ära\0İ")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumns({"id": F.lit(1), "n": F.lit(2), "terms": F.lit("z"), "kind": F.lit(0)})
    b = spark.createDataFrame(items, "item_id int, text string").withColumns({"item": F.lit(1), "name": F.lit("q")})
    got = [tuple(x) for x in lexical_search.search(d, b, **limits).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == _search(docs, items)
    assert lexical_search.search(d.limit(0), b).count() == 0 == lexical_search.search(d, b.limit(0)).count()


def _components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and den * n >= num * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("limits", [{}, {"cap": 3, "block": 8, "broadcast_bytes": 1}])
def test_minhash_equals_brute_force(spark, limits):
    r = random.Random(11)
    voc = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(6):
        base = [r.choice(voc) for _ in range(90)]
        for _ in range(25):
            x = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                x[r.randrange(90)] = r.choice(voc)
            rows.append((len(rows), " ".join(x)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "a B"), (904, "A b"), (905, "one two three"), (906, " ".join(r.choice(voc) for _ in range(20_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"set": F.lit(1), "rk": F.lit(2), "keys": F.lit(b"3")})
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash_dedup.near_duplicates(docs, **limits).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in _components(rows, 3, 85, 100).items()}
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_minhash_null_ids_and_repeats(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "x y z"), (None, "q r s t")], "doc_id long, text string")
    got = sorted((tuple(x) for x in minhash_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 1, 4, True), (None, 2, None, False)], key=str)


def test_circulant_signatures_estimate_similarity():
    a, b = " ".join(f"w{i}" for i in range(1000)), " ".join(f"w{i}" for i in range(150, 1000))
    x, y = minhash_dedup.minhashes(shingle_sets([a, b], 3), 2000)
    assert abs((x == y).mean() - 848 / 998) < 0.03
    assert len(np.unique(x)) > 900  # coordinates differ: the shift reorders the ring


def test_decontamination_lists_the_same_matches_for_any_number_of_passes(spark):
    from tidewell.llm import decontaminate

    w = [f"w{i}" for i in range(60)]
    items = [(10, " ".join(w[0:30])), (2, " ".join(w[5:40])), (None, " ".join(w[20:45])), (7, " ".join(w[0:30])), (3, " ".join(w[50:55])), (2, " ".join(w[12:33]))]
    texts = [(1, " ".join(w)), (2, "x " + " ".join(w[3:37]) + " y " + " ".join(w[18:60])), (3, "none"), (4, None)]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")

    def got(n):
        return {r.doc_id: (r.n_hit, r["items"], [tuple(m) for m in r.matches]) for r in decontaminate.contamination(docs, bench, max_bench_bytes=n).collect()}

    one = got(1 << 20)
    assert one == got(100) == got(300) and one[3] == one[4] == (0, [], [])

    def longest(text):
        d, best = (text or "").split(), {}
        for item, t in items:
            t = t.split()
            for p in range(len(d)):
                for q in range(len(t)):
                    n = 0
                    while p + n < len(d) and q + n < len(t) and d[p + n] == t[q + n]:
                        n += 1
                    if n >= min(10, len(t)):
                        best.setdefault(p, []).append((-n, item is None, str(item), q))
        out, to = [], 0
        for p in sorted(best):
            n, null, item, q = min(best[p])
            if p - n > to:
                out.append((p, -n, None if null else item, q))
                to = p - n
        return out

    for i, text in texts:
        assert one[i][2] == longest(text)


def test_scratch_removes_all_of_a_failed_stage_and_only_its_own_threads(spark):
    import threading

    from tidewell.llm import common

    outside = common.staged(spark.range(3), "t-outside")
    made = []

    def other():
        made.append(common.staged(spark.range(4), "t-other"))

    with pytest.raises(ZeroDivisionError), common.scratch(spark):
        inside = common.staged(spark.range(5), "t-inside")
        t = threading.Thread(target=other)
        t.start()
        t.join()
        raise ZeroDivisionError
    assert outside.count() == 3 and made[0].count() == 4
    with pytest.raises(Exception):  # noqa: B017
        inside.count()


def test_conflicting_toxic_labels_count_as_toxic(spark):
    from tidewell.llm import toxicity

    docs = spark.createDataFrame([(i, f"you vile creature {i}" if i % 2 else f"a kind word {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(i, 0) for i in range(1, 200, 2)], "doc_id long, toxic int")
    made = [toxicity.learn(docs, labels.orderBy(F.rand(s))) for s in (1, 2)]
    assert made[0].__getstate__() == made[1].__getstate__()
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, made[0]).collect()}
    assert all(got[i] == i % 2 for i in range(200))
