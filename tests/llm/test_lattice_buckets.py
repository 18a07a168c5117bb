"""The encoder beyond its broadcast: chunks and blocks meet in buckets, by keys that no two chunks share."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import common
from tidewell.llm import sentencepiece_lattice as lattice


def _texts(n):
    r = random.Random(6)
    return [None, "", " ", "é", "-" * 90] + [" ".join("".join(r.choices("abcdeénst", k=r.randint(1, 9))) for _ in range(r.randint(1, 40))) for _ in range(n)]


def test_many_buckets_and_blocks_equal_the_library(spark, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(lattice, "CHUNKS_A_BUCKET", 300)
    monkeypatch.setattr(lattice, "BLOCK", 4_000)
    sp, texts = sentencepiece.SentencePieceProcessor(model_file=lattice.MODEL), _texts(400)
    rows = spark.createDataFrame([*enumerate(texts), (None, "twice"), (3, "twice")], "doc_id long, text string").repartition(3)
    got = lattice.encode(rows, lattice.load(), broadcast_bytes=0).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted([*((i, sp.encode(t or "")) for i, t in enumerate(texts)), (None, sp.encode("twice")), (3, sp.encode("twice"))], key=key)
    assert all(r.round_trip for r in got)


def test_a_block_sends_a_row_for_each_bucket(spark):
    pieces = lattice.load()
    shared = spark.sparkContext.broadcast(pieces)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(_texts(300))], "id long, text string").repartition(2)
    table, seed = lattice.keyed_chunks(rows.select("text"), shared)
    encoded = lattice.lattice_ids(table, pieces)
    ids = {r.key: r.ids for r in encoded.collect()}
    blocks = common.staged(common.packed(rows, "text", 8_000), "blocks")
    got = lattice.answers(blocks, encoded, shared, seed, 5).collect()
    assert len(got) <= 5 * blocks.count() < sum(len(r.keys) // 8 for r in got)
    for r in got:
        keys, lens, flat = np.frombuffer(r.keys, np.int64), np.frombuffer(r.lens, np.int32), np.frombuffer(r.ids, np.int32)
        assert flat.tolist() == [i for k in keys.tolist() for i in ids[k]] and lens.tolist() == [len(ids[k]) for k in keys.tolist()]
    asked = {k for r in got for k in np.frombuffer(r.keys, np.int64).tolist()}
    assert asked == set(ids)


def test_chunks_that_share_a_key_get_another_seed(spark, monkeypatch):
    made, seeds = lattice.chunk_table, []
    monkeypatch.setattr(lattice, "chunk_table", lambda src, shared, seed: seeds.append(seed) or (made(src, shared, seed) if seed else made(src, shared, seed).withColumn("key", F.lit(5).cast("long"))))
    got = lattice.encode(spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string"), lattice.load()).collect()
    assert seeds == [0, 1] and all(r.round_trip and r.ids for r in got)
    assert set(lattice.chunks(["one two"], lattice.load(), 0)[3].tolist()).isdisjoint(lattice.chunks(["one two"], lattice.load(), 1)[3].tolist())
