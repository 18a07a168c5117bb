"""The similarity join's exchange by buckets and its groups by rare shingles."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tidewell.llm import jaccard_join


def _words(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**9)}" for _ in range(n))


def test_a_common_passage_makes_no_cloud(spark, monkeypatch):
    rng = random.Random(8)
    common, rows = _words(rng, 26), []
    for i in range(240):
        own = _words(rng, rng.randint(24, 60)).split()
        rows.append((2 * i, f"{common} {' '.join(own)}"))
        if i % 6 == 0:  # a near copy: one word changed
            own[-1] = "changed"
            rows.append((2 * i + 1, f"{common} {' '.join(own)}"))
    asked, clouds = [], jaccard_join._clouds
    monkeypatch.setattr(jaccard_join, "_clouds", lambda rest, *more: asked.append(rest.select("set").distinct().count()) or clouds(rest, *more))
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    want = {i: i - 1 if i % 2 and 100 * len(sets[i] & sets[i - 1]) >= 80 * len(sets[i] | sets[i - 1]) else i for i, _ in rows}
    got = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), cap=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert sum(want[i] != i for i, _ in rows) == 40 and sum(asked) < 60, asked


def test_rare_groups_hold_every_linked_pair(spark):
    rng = random.Random(3)
    parts = [_words(rng, 12) for _ in range(12)]
    texts = [" ".join(rng.sample(parts, rng.randint(4, 9)) + [_words(rng, rng.randint(0, 6))]) for _ in range(120)]
    texts += [t + " " + _words(rng, 2) for t in texts[:30]]
    sets = jaccard_join.shingle_sets(texts)
    keys = jaccard_join.set_keys(sets)
    assert keys == [jaccard_join.set_key(s) for s in sets] and jaccard_join.set_keys([sets[0][:0], sets[1]]) == [None, keys[1]]
    import zstandard

    packed = spark.createDataFrame([(k, bytearray(zstandard.compress(t.encode()))) for k, t in dict(zip(keys, texts, strict=True)).items()], "set long, text binary")
    groups = defaultdict(set)
    for r in jaccard_join.rare_groups(packed, 5, 80, 100, 3).collect():
        groups[r.sig].add((r.set, r.lo, r.heavy))
    for g in groups.values():
        assert {x[1:] for x in g} == {(min(x[0] for x in g), len(g) > 3)} and len(g) > 1
    together = {(a[0], b[0]) for g in groups.values() for a in g for b in g}
    linked = [(keys[i], keys[j]) for i in range(len(sets)) for j in range(i) if keys[i] != keys[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert len(linked) >= 20 and together.issuperset(linked)


def test_buckets_give_the_groups_of_all_rows(monkeypatch):
    monkeypatch.setattr(jaccard_join, "PACKED", 50)
    rng = np.random.default_rng(2)
    rows = [(int(s) - 2**62, int(x), bool(f)) for s, x, f in zip(rng.integers(0, 2**40, 60).repeat(10)[rng.permutation(600)], rng.integers(0, 9, 600), rng.random(600) < 0.02, strict=True)] + [(int(s), 1, False) for s in rng.integers(-(2**62), 2**62, 300)]
    batches = [pa.record_batch([pa.array([s << 1 | f for s, _, f in rows[i : i + 37]]), pa.array([x for _, x, _ in rows[i : i + 37]])], ["sig", "set"]) for i in range(0, len(rows), 37)]
    bodies = defaultdict(list)
    for b in jaccard_join.dealt(iter(batches), 7):
        for at, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            bodies[at].append(body)
    got = Counter(r for x in bodies.values() for b in jaccard_join._bucket_groups(x, 6) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    sets, big = defaultdict(set), {s for s, _, f in rows if f}
    for s, x, _ in rows:
        sets[s].add(x)
    assert len(bodies) == 7 and got == Counter((s, x, min(v), len(v) > 6 or s in big) for s, v in sets.items() if len(v) > 1 or s in big for x in v)
