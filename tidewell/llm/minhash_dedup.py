"""MinHash near-duplicates by circulant permutations.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a document's set holds its distinct
3-word shingles (a shorter text is one shingle). Two documents link when
100 * |r & s| >= 85 * |r | s|.

Circulant MinHash: one permutation, sigma, scatters the shingles over a ring of 2^32 places;
the second, pi, orders the places. Coordinate j of the signature is the least pi(sigma(x) + j c
mod 2^32) of the set: the ring is shifted by j steps of c, and two permutations give all
`bands * rows` coordinates. Both are bijections of 32-bit words (multiplications by odd
numbers and shifted exclusive ors), so that no table of the domain is kept.

A signature is cut into `bands` of `rows` coordinates. Sets that share a band are candidates:
at similarity s that has the probability 1 - (1 - s^rows)^bands, with 20 bands of 5 rows
0.999992 at 0.85 and more above. Candidates are compared by sketches that bound the overlap,
then exactly on their full sets (see jaccard_join, whose groups, pivots and blocks this
shares): each member of a band's group with its least, then the pairs across components of
small groups, then, in bounded blocks, large groups that still hold several components. So
groups have no cap on members or candidates, and all links of candidates between components are
found. Equal sets collapse before, so copies of any number are one candidate.

Defined results: null and empty texts, or texts without words, have n_shingles 0 and are
their own component (component_id is their id); ids that repeat stand for one document in
component_id; a null id takes the least id of its component, null if it has none, and isn't
kept. An empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_blocks, small_batches, staged
from .jaccard_join import CAP, Scheme, Settled, _mix, component_ids, group_links, grouped, keyed, set_keys, shingle_sets

WORDS, NUM, DEN, BANDS, ROWS = 3, 85, 100, 20, 5
#: The ring's step; odd, so that steps don't repeat.
_STEP = 0x9E3779B1


def minhashes(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Signatures (one row a set, `size` coordinates) of sets that aren't empty."""
    if not sets:
        return np.zeros((0, size), np.uint32)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    place = (_mix(np.concatenate(sets) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)  # sigma
    out = np.empty((len(sets), size), np.uint32)
    x, y = np.empty_like(place), np.empty_like(place)
    for j in range(size):
        np.add(place, np.uint32(j * _STEP & 0xFFFFFFFF), out=x)
        for shift, odd in ((16, 0x7FEB352D), (15, 0x846CA68B)):  # pi
            np.right_shift(x, np.uint32(shift), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(odd), out=x)
        out[:, j] = np.minimum.reduceat(x, starts)
    return out


def band_keys(hashes: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    n, size = hashes.shape
    parts = hashes.reshape(n, size // rows, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, size // rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (n, size // rows)).copy()
        for r in range(rows):
            key = _mix(key + parts[:, :, r])
    return key.view(np.int64)


def _members(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """rk, id, text -> rk, id, set, n, keys: the set's digest and size, and its band keys where the task meets it first."""
    seen: set[int] = set()
    for b in in_blocks(batches, "text", 2 << 20):
        sets = shingle_sets(b.column(2).to_pylist(), k)
        keys = set_keys(sets)
        new = []
        for i, key in enumerate(keys):
            if key is not None and key not in seen:
                seen.add(key)
                new.append(i)
        found: list[bytes | None] = [None] * len(sets)
        for i, row in zip(new, band_keys(minhashes([sets[i] for i in new], bands * rows), rows), strict=True):
            found[i] = row.tobytes()
        sizes = [len(s) for s in sets]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], ["rk", "id", "set", "n", "keys"])


def _signed(batches: Iterator[pa.RecordBatch], bands: int, cap: int, block: int = 20_000) -> Iterator[pa.RecordBatch]:
    """set, keys -> sig, set, hot bands settled."""
    out, held, n = Settled(cap), [], 0

    def block_rows():
        t = pa.Table.from_batches(held)
        keys = np.frombuffer(b"".join(t["keys"].to_pylist()), np.int64)
        return out.block(keys, np.repeat(t["set"].to_numpy(), bands))

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= block:
            yield from block_rows()
            held, n = [], 0
    if held:
        yield from block_rows()
    yield from out.close()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, num: int = NUM, den: int = DEN, bands: int = BANDS, rows: int = ROWS, cap: int = CAP, block: int = 512, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id, kept."""
    small_batches(docs.sparkSession)
    src = keyed(docs, id_col, text_col)
    members = staged(src.mapInArrow(lambda it: _members(it, k, bands, rows), f"rk long, id {dict(src.dtypes)['id']}, set long, n long, keys binary"), "minhash-members")
    groups = grouped(members.where("keys is not null").select("set", "keys"), lambda it: _signed(it, bands, cap), cap)
    _, comps = group_links(src, members, groups, Scheme(num, den), k, cap, block, broadcast_bytes)
    out = component_ids(members, comps, id_col)
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
