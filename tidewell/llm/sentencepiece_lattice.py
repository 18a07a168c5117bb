"""SentencePiece encoding and decoding over a relational lattice.

1. Texts are cut into chunks where no piece of the table holds the two neighbouring
   characters together: no piece can cross such a cut, so chunks are independent. All
   distinct chunks of the corpus form the chunk table.
2. Lattice: each chunk's substrings of bounded length (the longest piece) are exploded and
   equi-joined to the piece table (bounded by the vocabulary, so broadcast); the edges are
   grouped by chunk.
3. Fold: a higher-order `aggregate` over the edges. The given model is a byte-pair model,
   for which the path of the best summed score (Viterbi) is not the model's encoding; so
   the fold replays the model's merges instead. Boundaries are bits of a long, and an edge
   is one long. One pass over the edges, sorted by score and then from the left, is enough:
   an edge whose ends are boundaries and that has one boundary inside removes it. A piece is
   regular if its own parts all merge before it does; then its edge can't become applicable
   after its turn. `Pieces.irregular` holds the others (here runs of spaces); a chunk with
   such an edge starts over after every merge instead. Characters without a piece become the
   ids of their bytes.
4. The encoded chunks return to the documents by their 64-bit keys, which are made anew with
   another seed should two chunks share one: as a broadcast table while its counted size is
   at most `broadcast_bytes`; beyond that each block of texts asks for its distinct keys. The
   chunks and what is asked meet in buckets of keys and travel packed, a binary for each
   block and bucket, and a block's answers meet its texts.

Chunks longer than 62 characters (long runs of letters or spaces) are merged by the same
rule in a heap, in a Python function: a long has no more bits.

Defined results: null and empty texts give no ids; U+2581 in a text is encoded like a space,
as the model does, and decodes to a space; ids of rows may repeat or be null; other columns
are ignored.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_blocks, packed, small_batches, staged, unpacked

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, LONGEST, BLOCK = "▁", 62, 4 << 20


class Pieces:
    """The vocabulary: pieces, scores, byte ids, and which neighbouring characters may stand in one piece."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], special: set[int]):
        self.pieces, self.scores, self.byte_ids, self.special = pieces, scores, byte_ids, special
        skip = special | set(byte_ids)
        self.index = {p: i for i, p in enumerate(pieces) if i not in skip}
        self.longest = max(map(len, self.index), default=1)
        together = {(ord(p[i]), ord(p[i + 1])) for p in self.index for i in range(len(p) - 1)}
        self._chars = sorted({c for x in together for c in x})
        self._together = together

    @functools.cached_property
    def classes(self) -> np.ndarray:
        out = np.zeros(0x110000, np.int32)
        out[self._chars] = np.arange(1, len(self._chars) + 1)
        return out

    @functools.cached_property
    def joinable(self) -> np.ndarray:
        at = {c: i + 1 for i, c in enumerate(self._chars)}
        out = np.zeros((len(at) + 1, len(at) + 1), bool)
        for a, b in self._together:
            out[at[a], at[b]] = True
        return out

    @functools.cached_property
    def raw(self) -> list[bytes]:
        """Bytes of each id; special ids have none."""
        byte = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        return [byte[i] if i in byte else b"" if i in self.special else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]

    @functools.cached_property
    def irregular(self) -> list[int]:
        """Ids of pieces whose edge could become applicable after edges of worse scores were merged."""
        rank = {i: -self.scores[i] for i in self.index.values()}

        def regular(piece: str, own: float) -> bool:
            parts = list(piece)
            while len(parts) > 2:
                known = ((rank[p], i) for i in range(len(parts) - 1) if (p := self.index.get(parts[i] + parts[i + 1])) is not None)
                best, i = min(known, default=(own, 0))
                if best >= own:
                    return False
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            return True

        return [i for p, i in self.index.items() if not regular(p, rank[i])]

    @functools.cached_property
    def raw_array(self) -> np.ndarray:
        return np.array(self.raw, object)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        text = b"".join(self.raw_array[ids].tolist() if len(ids) else []).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def merge(self, chunk: str) -> list[int]:
        """The ids of one chunk of any length: merges by score, then from the left, kept in a heap."""
        n = len(chunk)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[float, int, int]] = []

        def propose(i: int) -> None:
            j = end[i] if i >= 0 else n
            if i >= 0 and j < n and (p := self.index.get(chunk[i : end[j]])) is not None and end[j] - i <= self.longest:
                heapq.heappush(heap, (-self.scores[p], i, end[j]))

        for i in range(n - 1):
            propose(i)
        while heap:
            _, i, e = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[i] == e or end[end[i]] != e:
                continue
            alive[end[i]] = False
            end[i] = e
            if e < n:
                before[e] = i
            propose(i)
            propose(before[i])
        out, i = [], 0
        while i < n:
            p = self.index.get(chunk[i : end[i]])
            out.extend([p] if p is not None else [self.byte_ids[b] for b in chunk[i : end[i]].encode("utf-8", "surrogatepass")])
            i = end[i]
        return out


@functools.lru_cache(4)
def load(path: str = MODEL) -> Pieces:
    """The table of a model file, read on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
    return Pieces([sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids], [i for i in ids if sp.is_byte(i)], special)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def chunks(texts: list[str | None], pieces: Pieces, seed: int = 0) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined marked texts; chunk starts, lengths and 64-bit keys in it; and the number of chunks of each text."""
    marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
    joined = "".join(marked)
    lens = np.array([len(m) for m in marked], np.int64)
    if not joined:
        z = np.zeros(0, np.int64)
        return joined, z, z, z, np.zeros(len(texts), np.int64)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = pieces.classes[cp]
    cut = np.ones(len(cp), bool)
    cut[1:] = ~pieces.joinable[cls[:-1], cls[1:]]
    heads = (np.cumsum(lens) - lens)[lens > 0]
    cut[heads] = True
    starts = np.flatnonzero(cut)
    sizes = np.diff(np.append(starts, len(cp)))
    pos = (np.arange(len(cp)) - np.repeat(starts, sizes)).astype(np.uint64)
    with np.errstate(over="ignore"):
        keys = np.add.reduceat(_mix(cp.astype(np.uint64) + np.uint64(seed << 32) + (pos + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), starts).view(np.int64)
    ends = np.cumsum(lens)
    counts = np.searchsorted(starts, ends) - np.searchsorted(starts, ends - lens)
    return joined, starts, sizes, keys, counts


#: Bytes of text that a task cuts into chunks at a time; a worker takes some forty times as much for it.
CHUNK_BYTES = 1 << 19


#: Keys that a task remembers, so that it seldom sends a chunk twice.
SEEN = 1 << 20


def chunk_table(src: DataFrame, shared, seed: int = 0) -> DataFrame:
    """The distinct chunks of src.text, as key and chunk."""
    small_batches(src.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = ~np.arange(SEEN)  # the last key at each place; a place never begins with a key of its own
        for b in in_blocks(batches, "text", CHUNK_BYTES):
            joined, starts, sizes, keys, _ = chunks(b.column(0).to_pylist(), shared.value, seed)
            at = keys & (SEEN - 1)
            new = np.flatnonzero(last[at] != keys)
            keys, first = np.unique(keys[new], return_index=True)
            last[keys & (SEEN - 1)] = keys
            found = [joined[s : s + n] for s, n in zip(starts[new[first]].tolist(), sizes[new[first]].tolist(), strict=True)]
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(found, pa.string())], ["key", "chunk"])
            pa.default_memory_pool().release_unused()

    return src.mapInArrow(run, "key long, chunk string").distinct()


def keyed_chunks(src: DataFrame, shared) -> tuple[DataFrame, int]:
    """The chunk table, staged, and a seed by which no two chunks share a key."""
    for seed in range(8):
        table = staged(chunk_table(src, shared, seed), "pieces-chunks")
        if table.groupBy("key").count().where("count > 1").isEmpty():
            return table, seed
    raise ValueError("chunks share keys under every seed")


#: One edge in a long: rank of its score, start, end, piece id; so edges sort by score, then from the left.
_EDGE = "shiftleft(cast(rank as bigint), 32) | shiftleft(cast(s as bigint), 26) | shiftleft(cast(e as bigint), 20) | cast(id as bigint)"
#: The id of a single character without a piece.
_NONE = 1048575
_S, _E = "cast(shiftright(x, 26) & 63L as int)", "cast(shiftright(x, 20) & 63L as int)"
_INSIDE, _ENDS = f"(shiftleft(1L, {_E}) - shiftleft(2L, {_S}))", f"(shiftleft(1L, {_S}) | shiftleft(1L, {_E}))"
_ALL = "~shiftleft(-1L, n + 1)"
_ONE_PASS = f"""
aggregate(wide, {_ALL}, (st, x) -> if((st & {_ENDS}) = {_ENDS} and bit_count(st & {_INSIDE}) = 1, st & ~{_INSIDE}, st))
"""
_START_OVER = f"""
aggregate(sequence(1, greatest(n - 1, 1)), {_ALL}, (st, i) -> st & ~coalesce(
  get(transform(filter(wide, x -> (st & {_ENDS}) = {_ENDS} and bit_count(st & {_INSIDE}) = 1), x -> {_INSIDE}), 0), 0L))
"""
#: Chunks a task groups at a time, and the number beyond which its hash table gives way to a sort.
CHUNKS_A_TASK, HASHED = 16_000, 64_000


def lattice_ids(table: DataFrame, pieces: Pieces) -> DataFrame:
    """key, chunk and ids of every chunk of the table (key, chunk), staged."""
    spark = table.sparkSession
    ranks = {x: i for i, x in enumerate(sorted({-pieces.scores[i] for i in pieces.index.values()}))}
    rows = [(p, i, ranks[-pieces.scores[i]]) for p, i in pieces.index.items()]
    vocabulary = F.broadcast(spark.createDataFrame(rows, "piece string, id int, rank int"))
    short = table.where(F.length("chunk") <= LONGEST)
    parts = max(1, -(-short.count() // CHUNKS_A_TASK))
    short = short.repartition(parts, "key").withColumn("n", F.length("chunk"))
    starts = short.selectExpr("key", "chunk", "n", "explode(sequence(0, n - 1)) as s")
    spans = starts.selectExpr("key", "chunk", "n", "s", f"explode(sequence(s + 1, least(n, s + {pieces.longest}))) as e").selectExpr("key", "chunk", "n", "s", "e", "substring(chunk, s + 1, e - s) as piece")
    # Every single character gives an edge, so that it has an id or is known to have none.
    # Rows are dealt by key already, so the grouping needs no further exchange.
    known = spans.join(vocabulary, "piece", "left").where("id is not null or e = s + 1").selectExpr("key", "chunk", "s", "e", f"coalesce(id, {_NONE}) as id", "coalesce(rank, 0) as rank")
    odd = f"bool_or(id in ({', '.join(map(str, [-1, *pieces.irregular]))}))"
    edges = known.groupBy("key", "chunk").agg(F.expr(f"collect_list({_EDGE})").alias("edges"), F.expr(odd).alias("odd"))
    sorted_wide = edges.selectExpr("key", "chunk", "length(chunk) as n", "edges", "odd", f"array_sort(filter(edges, x -> {_E} - {_S} > 1)) as wide")
    folded = sorted_wide.selectExpr("key", "chunk", "edges", f"if(odd, {_START_OVER}, {_ONE_PASS}) as bits")
    # The edges between neighbouring boundaries, from the left.
    path = folded.selectExpr("key", "chunk", f"array_sort(transform(filter(edges, x -> (bits & {_ENDS}) = {_ENDS} and (bits & {_INSIDE}) = 0), x -> x & 4294967295L)) as path")
    as_bytes = f"transform(sequence(0, octet_length(substring(chunk, {_S} + 1, 1)) - 1), j -> cast(conv(substring(hex(encode(substring(chunk, {_S} + 1, 1), 'UTF-8')), 2 * j + 1, 2), 16, 10) as int) + {pieces.byte_ids[0] if pieces.byte_ids else 0})"
    id_of = "cast(x & 1048575L as int)"
    ids = path.selectExpr("key", "chunk", f"if(exists(path, x -> {id_of} = {_NONE}), flatten(transform(path, x -> if({id_of} = {_NONE}, {as_bytes}, array({id_of})))), transform(path, x -> {id_of})) as ids")
    shared = spark.sparkContext.broadcast(pieces)

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_blocks(batches, "chunk", 1 << 20):
            yield pa.record_batch([b.column(0), b.column(1), pa.array([shared.value.merge(c) for c in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["key", "chunk", "ids"])

    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(HASHED))
    try:
        return staged(ids.unionByName(table.where(F.length("chunk") > LONGEST).select("key", "chunk").mapInArrow(long, "key long, chunk string, ids array<int>")), "pieces-ids")
    finally:
        spark.conf.set(name, before)


def _gathered(keys: np.ndarray, known: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each key, and the ids one after another; known is sorted and has every key."""
    at = np.searchsorted(known, keys)
    lens = (offsets[at + 1] - offsets[at]).astype(np.int64)
    total = np.cumsum(lens) - lens
    return lens, values[np.repeat(offsets[at] - total, lens) + np.arange(int(lens.sum()))]


def _ordered(keys: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table (known, offsets, values) of keys in any order, their numbers of ids, and the ids one after another."""
    by = np.argsort(keys)
    starts, sizes = (np.cumsum(lens) - lens)[by], lens[by].astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return keys[by], offsets, ids[np.repeat(starts - offsets[:-1], sizes) + np.arange(int(offsets[-1]))]


def _rows(ids: pa.Array, texts: list[str | None], pieces: Pieces, seed: int, *table: np.ndarray) -> pa.RecordBatch:
    """id, ids and round_trip of each text, by a table (known, offsets, values) that has all their chunks."""
    _, _, _, keys, counts = chunks(texts, pieces, seed)
    distinct, back = np.unique(keys, return_inverse=True)
    lens, flat = _gathered(distinct, *table)
    starts = np.cumsum(lens) - lens
    lens, starts = lens[back], starts[back]
    total = np.concatenate([[0], np.cumsum(lens)])
    flat = flat[np.repeat(starts - total[:-1], lens) + np.arange(total[-1])].astype(np.int32)
    ends = total[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
    same = [pieces.decode(flat[s:e]) == (t or "").replace(SPACE, " ") for t, s, e in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return pa.record_batch([ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(same, pa.bool_())], ["id", "ids", "round_trip"])


#: Chunks of a bucket, where keys of chunks and of blocks meet.
CHUNKS_A_BUCKET = 64_000


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of keys by bucket, the buckets that there are, and where each begins in that order."""
    with np.errstate(over="ignore"):
        at = ((_mix(keys.view(np.uint64) + np.uint64(1)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    by = np.lexsort((keys, at))
    at = at[by]
    edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    return by, at[edges], edges


def answers(blocks: DataFrame, encoded: DataFrame, shared, seed: int, buckets: int) -> DataFrame:
    """block, keys, lens, ids: what the blocks (block, body) need of the encoded chunks, a row for each block and bucket."""
    kind = "bucket int, block long, keys binary, lens binary, ids binary"
    names = ["bucket", "block", "keys", "lens", "ids"]

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys, lists = b.column(0).to_numpy(), b.column(1)
            by, at, edges = _by_bucket(keys, buckets)
            lists = lists.take(pa.array(by))
            ends = [*edges[1:].tolist(), len(by)]
            part = [(lists.slice(i, j - i), i, j) for i, j in zip(edges.tolist(), ends, strict=True)]
            lens = [np.diff(x.offsets.to_numpy()).astype(np.int32).tobytes() for x, _, _ in part]
            ids = [x.flatten().to_numpy().astype(np.int32).tobytes() for x, _, _ in part]
            yield pa.record_batch([pa.array(at), pa.nulls(len(at), pa.int64()), pa.array([keys[by[i:j]].tobytes() for _, i, j in part], pa.binary()), pa.array(lens, pa.binary()), pa.array(ids, pa.binary())], names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                parts = [np.unique(chunks(part.column("text").to_pylist(), shared.value, seed)[3]) for part in unpacked(body, "text", CHUNK_BYTES)]
                keys = np.unique(np.concatenate(parts))
                by, at, edges = _by_bucket(keys, buckets)
                wanted = [keys[by[i:j]].tobytes() for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(by)], strict=True)]
                nothing = pa.nulls(len(at), pa.binary())
                yield pa.record_batch([pa.array(at), pa.array([block] * len(at), pa.int64()), pa.array(wanted, pa.binary()), nothing, nothing], names)

    def meet(t: pa.Table) -> pa.Table:
        mine = t.filter(pc.is_null(t["block"]))
        keys, lens, ids = (np.frombuffer(b"".join(mine[c].to_pylist()), dtype) for c, dtype in (("keys", np.int64), ("lens", np.int32), ("ids", np.int32)))
        table = _ordered(keys, lens, ids)
        asked = t.filter(pc.is_valid(t["block"]))
        found = [_gathered(np.frombuffer(x, np.int64), *table) for x in asked["keys"].to_pylist()]
        return pa.table([asked["block"], asked["keys"], pa.array([n.astype(np.int32).tobytes() for n, _ in found], pa.binary()), pa.array([x.tobytes() for _, x in found], pa.binary())], ["block", "keys", "lens", "ids"])

    rows = encoded.select("key", "ids").mapInArrow(known, kind).unionByName(blocks.mapInArrow(ask, kind))
    return rows.groupBy("bucket").applyInArrow(meet, "block long, keys binary, lens binary, ids binary")


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 256 << 20) -> DataFrame:
    """Per row of docs: id, ids and round_trip (the ids decode to the text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pieces)
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = f"id {dict(src.dtypes)['id']}, ids array<int>, round_trip boolean"
    table, seed = keyed_chunks(src.select("text"), shared)
    encoded = lattice_ids(table, pieces)
    size = encoded.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("ids")).first()
    if size.n * 16 + size.ids * 4 <= broadcast_bytes:
        got = encoded.select("key", "ids").orderBy("key").toArrow()
        lists = got.column("ids").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        lookup = spark.sparkContext.broadcast((got.column("key").to_numpy(), lists.offsets.to_numpy(), lists.values.to_numpy().astype(np.uint16 if len(pieces.pieces) <= 1 << 16 else np.int32)))
        del got, lists
        pa.default_memory_pool().release_unused()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in in_blocks(batches, "text", CHUNK_BYTES):
                yield _rows(b.column(0), b.column(1).to_pylist(), shared.value, seed, *lookup.value)
                pa.default_memory_pool().release_unused()

        return src.mapInArrow(run, kind).withColumnRenamed("id", id_col)

    # Beyond the bound: each block asks for its distinct chunks, whatever the number of their occurrences.
    blocks = staged(packed(src, "text", BLOCK), "pieces-blocks")

    def answer(mine: pa.Table, got: pa.Table) -> pa.Table:
        keys, lens, ids = (np.frombuffer(b"".join(got[c].to_pylist()), dtype) for c, dtype in (("keys", np.int64), ("lens", np.int32), ("ids", np.int32)))
        table = _ordered(keys, lens, ids)
        return pa.Table.from_batches([_rows(part.column("id"), part.column("text").to_pylist(), shared.value, seed, *table) for body in mine["body"].combine_chunks() for part in unpacked(body, "text", CHUNK_BYTES)])

    found = answers(blocks, encoded, shared, seed, max(1, -(-size.n // CHUNKS_A_BUCKET)))
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(answer, kind).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, pieces: Pieces, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and text; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)
    src = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([shared.value.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, text string").withColumnRenamed("id", id_col)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its ids, their number, and whether they decode to the text."""
    return encode(documents(spark, sf_dir), load()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")
