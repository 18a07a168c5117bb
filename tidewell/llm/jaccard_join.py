"""Similarity join on word shingles by PartEnum signatures.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a document's set holds its distinct
5-word shingles (a shorter text is one shingle). Two documents link when
100 * |r & s| >= 80 * |r | s|. Shingles are 64-bit hashes, and a set is known by the 64-bit
digest of its sorted shingles: among n different ones the odds of any collision are about
n^2 / 2^65. Otherwise the join is exact.

1. Equal sets collapse.
2. PartEnum: sets with |r| + |s| = m that link differ in at most k = floor(m / 9) shingles.
   The shingle domain is cut into n1 > k / 2 partitions, so some partition has at most one
   difference; each partition is cut into three parts, and every subset of two of the three
   is enumerated: one of them has no difference. A signature is the digest of a subset's
   content, its place and n1. n1 follows bands of sizes; sets emit for every band that a
   partner's size (0.8 to 1.25 times) may ask for, so similar sets of equal or neighbouring
   bands share a signature. A set with too few non-empty subsets emits its empty ones too,
   so nothing is lost.
3. A signature that more than `cap` sets of one block of texts share is settled in that
   block: there its sets are a group of their own, and only the least of them stays in the
   shared one; the same once more over the blocks of a task. So a hot signature reaches its
   task of the exchange as at most `cap` rows from each block before. Rows are dealt to
   buckets by a hash of their signature and travel packed: a task sends one binary for each
   bucket and PACKED rows, so the JVM moves few rows, and a bucket is put in order as arrays.
   Only signatures that occur twice in it go on to the groups. If the shared group holds
   several components in the end, the groups settled below it are opened as well.
4. Within a group each member is compared with the group's least member;
   verified links give components. Only groups that still hold several components go on.
   Groups of at most `cap` members compare the pairs across components. A larger group
   matters only to sets that have too few small groups to be sure (their distance could touch
   all of those). What makes such a group large is mostly a common passage, so these sets are
   grouped once more, by their rarest shingles among them: of a set of n all but the
   ceil(0.8 n) - 1 most frequent ones, of which two linked sets share one in any case; a set
   whose rarest ones are its own leaves. Small groups compare pairs again, large ones their
   least member, and large ones that hold several components still hang together as clouds.
   A cloud is dealt into blocks of about `block` sets, and each pair of blocks is one bounded
   product of incidence matrices that returns one link for each two components. Blocks inside
   one component aren't compared. So no link between components is lost, and no pairs of a hot
   group are emitted; the work within one cloud, a family of near copies that no member links,
   does grow with the square of its blocks.

Candidates are compared by sketches first (counts of 256 parts of the domain bound the
distance from below, so no link is lost). Verification reads the texts themselves; only
candidate sets' texts are fetched (their keys are broadcast while counted at no more than
`broadcast_bytes`, else joined by sort-merge), and they travel compressed.

Defined results: null and empty texts, or texts without words, have n_shingles 0 and are
their own component (component_id is their id); ids that repeat stand for one document in
component_id; a null id takes the least id of its component, null if it has none. An empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, in_blocks, small_batches, staged
from .components import components

WORDS, CAP = 5, 16
_A = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str | None], k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    lens = np.array([len(w) for w in split], np.int64)
    flat = [w for ws in split for w in ws]
    hashed = pd.util.hash_array(np.array(flat, dtype=object), categorize=False) if flat else np.zeros(0, np.uint64)
    padded = np.concatenate([hashed, np.zeros(k, np.uint64)])
    with np.errstate(over="ignore"):
        rolled = sum(padded[j : j + len(hashed)] * _A[j % 5] * np.uint64(2 * (j // 5) + 1) for j in range(k)) if flat else hashed
        mixed = _mix(rolled)
    out, start = [], 0
    for n in lens.tolist():
        if n >= k:
            s = np.sort(mixed[start : start + n - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            with np.errstate(over="ignore"):
                out.append(_mix(np.array([sum((int(h) * int(_A[j % 5]) for j, h in enumerate(hashed[start : start + n])), n) & (2**64 - 1)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        start += n
    return out


def set_key(s: np.ndarray) -> int:
    """Signed 64-bit digest of a set."""
    with np.errstate(over="ignore"):
        return int(_mix(np.array([s.sum(dtype=np.uint64) + np.bitwise_xor.reduce(_mix(s + _A[1])) * _A[0] + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def set_keys(sets: list[np.ndarray]) -> list[int | None]:
    """set_key of each set; None for empty ones."""
    full = [s for s in sets if len(s)]
    if not full:
        return [None] * len(sets)
    flat, lens = np.concatenate(full), np.array([len(s) for s in full])
    at = np.cumsum(lens) - lens
    with np.errstate(over="ignore"):
        keys = iter(_mix(np.add.reduceat(flat, at) + np.bitwise_xor.reduceat(_mix(flat + _A[1]), at) * _A[0] + lens.astype(np.uint64)).view(np.int64).tolist())
    return [next(keys) if len(s) else None for s in sets]


#: First-level partitions: bands of this ratio.
_GRID = np.unique([round(1.5625**i) for i in range(50)])
#: Second-level parts of each partition, differences allowed in it, and the subsets enumerated.
PARTS_2, ERRORS_2 = 3, 1
SUBSETS = list(itertools.combinations(range(PARTS_2), PARTS_2 - ERRORS_2))


class Scheme:
    """Partitions per size and the distance bound, for a threshold num/den and a slack."""

    def __init__(self, num: int = 80, den: int = 100, slack: float = 1.0):
        self.num, self.den, self.slack = num, den, slack
        self._levels: dict[int, list[tuple[int, int]]] = {}

    def bound(self, m: int) -> int:
        """Most differing elements of two linked sets of m elements together: m - 2i with i >= num/(num+den) m."""
        return m - 2 * -(-self.num * m // (self.num + self.den))

    def parts(self, largest: int) -> int:
        """First-level partitions for pairs whose larger set has this size, so many that one has no more than ERRORS_2 differences; 0 if such sets link only if equal."""
        k = max(self.bound(2 * largest), self.bound(2 * largest - 1), 0)
        return int(_GRID[np.searchsorted(_GRID, self.slack * (k // (ERRORS_2 + 1) + 1))]) if k else 0

    @staticmethod
    def touched(g: int, k: int) -> int:
        """Most of the g partitions' three subsets each that k differences can touch: the first in a partition touches two, a second the third."""
        return 2 * k if k <= g else min(3 * g, g + k)

    def levels(self, size: int) -> list[tuple[int, int]]:
        """(partitions, distance bound) of every level on which a set of this size may meet a partner."""
        if size not in self._levels:
            top = size * self.den // self.num
            found: dict[int, int] = {}
            for largest in sorted({size, top, *self._steps(size, top)}):
                g = self.parts(largest)
                if g:
                    found[g] = max(found.get(g, 0), (size + largest) * (self.den - self.num) // (self.num + self.den))
            self._levels[size] = sorted(found.items())
        return self._levels[size]

    def _steps(self, low: int, high: int):
        """The largest size of each level between low and high."""
        while low < high:
            g, a, b = self.parts(low), low, high
            while a < b:
                mid = (a + b + 1) // 2
                a, b = (mid, b) if self.parts(mid) == g else (a, mid - 1)
            yield a
            if a < high:
                yield a + 1
            low = a + 1


def signatures(sets: list[np.ndarray], scheme: Scheme, only_spare: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, the index of their set, and per set the least number of non-empty subsets that a partner shares for sure; only_spare leaves the first two empty."""
    rows = [(i, g, k) for i, s in enumerate(sets) if len(s) for g, k in scheme.levels(len(s))]
    spare = np.full(len(sets), 2**31 - 1, np.int64)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), spare
    owner, firsts, bound = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    lens = np.array([len(sets[i]) for i in owner])
    flat = np.concatenate([sets[i] for i in owner])
    base = np.cumsum(firsts) - firsts  # the first partition of each row
    row = np.repeat(np.arange(len(rows)), lens)
    with np.errstate(over="ignore"):
        part = base[row] * PARTS_2 + (((flat >> np.uint64(32)) * (firsts[row] * PARTS_2).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)  # rises with the element, so parts are runs
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        full = np.zeros((int(firsts.sum()), PARTS_2), bool)
        full.reshape(-1)[part[first]] = True
        of = np.repeat(np.arange(len(rows)), firsts)
        some = np.stack([np.logical_or.reduce([full[:, j] for j in subset]) for subset in SUBSETS], 1)
        sure = np.bincount(of, some.sum(1), len(rows)).astype(np.int64) - np.array([scheme.touched(g, k) for _, g, k in rows])
        np.minimum.at(spare, owner, sure)
        if only_spare:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), spare
        some |= (sure <= 0)[of][:, None]  # too few subsets in use: the empty ones count as well
        content = np.zeros(full.shape, np.uint64)
        content.reshape(-1)[part[first]] = np.add.reduceat(_mix(flat + _A[2]), first)
        place = (np.arange(len(of)) - base[of]).astype(np.uint64) * _A[3] + firsts[of].astype(np.uint64) * _A[4]
        parts = [_mix(content[:, j] + np.uint64(j + 1) * _A[0]) for j in range(PARTS_2)]
        sig = np.stack([_mix(sum(parts[j] for j in subset) + place + np.uint64(n + 1) * _A[1]) for n, subset in enumerate(SUBSETS)], 1)
    return sig[some].view(np.int64), np.repeat(owner[of], some.sum(1)), spare


def _members(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """rk, id, text -> rk, id, set, n."""
    for b in in_blocks(batches, "text", 1 << 20):
        sets = shingle_sets(b.column(2).to_pylist(), k)
        yield pa.record_batch([b.column(0), b.column(1), pa.array(set_keys(sets), pa.int64()), pa.array([len(s) for s in sets], pa.int64())], ["rk", "id", "set", "n"])
        pa.default_memory_pool().release_unused()


class Settled:
    """A task's rows (sig, set) on their way to the exchange. A signature that more than `cap` sets of a block share is settled there: its sets get a signature of their own, only the least of them stays in the shared one, its last bit set. Where that leaves more than `cap` rows of the task's blocks, these are settled once more over the task."""

    def __init__(self, cap: int, most: int = 1 << 16):
        self.cap, self.most, self.part, self.no = cap, most, TaskContext.get().partitionId(), 0
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def _split(self, sig: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """sig and set of rows to send, then of the least sets that stand for a hot signature."""
        _, which, n = np.unique(sig, return_inverse=True, return_counts=True)
        hot = n[which] > self.cap
        by = np.lexsort((sets[hot], which[hot]))
        x, s, g = sets[hot][by], sig[hot][by], which[hot][by]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        self.no += 1
        with np.errstate(over="ignore"):
            own = _mix(s.view(np.uint64) + np.uint64(self.part << 32 | self.no) * _A[1] + _A[0]).view(np.int64) & ~1
        return np.concatenate([sig[~hot], own]), np.concatenate([sets[~hot], x]), s[first], x[first]

    def block(self, sig: np.ndarray, sets: np.ndarray) -> Iterator[pa.RecordBatch]:
        sig, sets, hot, least = self._split(sig & ~1, sets)
        if len(hot):
            self.held.append((hot, least))
        yield self._rows(sig, sets)
        if sum(len(s) for s, _ in self.held) > self.most:
            yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            sig, sets = (np.concatenate(x) for x in zip(*self.held, strict=True))
            known = np.unique(sig)
            sig, sets, hot, least = self._split(sig, sets)
            yield self._rows(np.concatenate([np.where(np.isin(sig, known), sig | 1, sig), hot | 1]), np.concatenate([sets, least]))
            self.held = []

    @staticmethod
    def _rows(sig: np.ndarray, sets: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(sig), pa.array(sets)], ["sig", "set"])


def _signed(batches: Iterator[pa.RecordBatch], k: int, scheme: Scheme, cap: int) -> Iterator[pa.RecordBatch]:
    """text -> sig, set (see Settled); copies within the task count once."""
    seen: set[int] = set()
    out = Settled(cap)
    for b in in_blocks(batches, "text", 1 << 20):
        fresh = []
        sets = shingle_sets(b.column(0).to_pylist(), k)
        for key, s in zip(set_keys(sets), sets, strict=True):
            if key is not None and key not in seen:
                seen.add(key)
                fresh.append((key, s))
        sig, owner, _ = signatures([s for _, s in fresh], scheme)
        if len(sig):
            yield from out.block(sig, np.array([k for k, _ in fresh], np.int64)[owner])
    yield from out.close()


#: Rows that a task holds before it packs them, and buckets for each partition of the exchange.
PACKED, BUCKETS = 1 << 17, 4


def dealt(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """sig, set -> bucket, body: the signatures, then the sets, of a bucket's rows among PACKED."""
    held, n = [], 0

    def packs() -> pa.RecordBatch:
        sig, sets = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        at = ((_mix((sig >> 1).view(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
        by = np.argsort(at, kind="stable")
        sig, sets, at = sig[by], sets[by], at[by]
        edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        bodies = [sig[i:j].tobytes() + sets[i:j].tobytes() for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(at)], strict=True)]
        return pa.record_batch([pa.array(at[edges].astype(np.int32)), pa.array(bodies, pa.binary())], ["bucket", "body"])

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= PACKED:
            yield packs()
            held, n = [], 0
            pa.default_memory_pool().release_unused()
    if held:
        yield packs()


def _bucket_groups(bodies: list[bytes], cap: int) -> list[pa.RecordBatch]:
    """The groups (see _groups) of a whole bucket; what occurs once is left out before it is sorted by set."""
    arrays = [np.frombuffer(b, np.int64) for b in bodies]
    sig, sets = (np.concatenate(x) for x in zip(*((a[: len(a) // 2], a[len(a) // 2 :]) for a in arrays), strict=True))
    by = np.argsort(sig)  # the last bit is the flag, so rows of one group stay together
    sig, sets = sig[by], sets[by]
    big, sig = (sig & 1).astype(bool), sig >> 1
    same = sig[1:] == sig[:-1]
    keep = big | np.concatenate([same, [False]]) | np.concatenate([[False], same])
    sig, sets, big = sig[keep], sets[keep], big[keep]
    by = np.lexsort((~big, sets, sig))
    pa.default_memory_pool().release_unused()
    return list(_groups(iter([pa.record_batch([pa.array(sig[by]), pa.array(sets[by]), pa.array(big[by])], ["sig", "set", "big"])]), cap))


def _groups(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    """Rows (sig, set and, if there, big) sorted by sig, set and big, true first -> sig, set, lo (the group's least set), heavy (more than cap members, or one that is big), of groups with two sets or more, or heavy ones. Keeps cap + 1 rows of an open group at most."""
    sig = sets = np.zeros(0, np.int64)  # the open group's rows while it isn't heavy
    big = np.zeros(0, bool)
    lo = None  # set once the open group is heavy
    last_sig = last_set = None

    def out(s, x, low, heavy):
        return pa.record_batch([pa.array(s), pa.array(x), pa.array(low), pa.array(heavy)], ["sig", "set", "lo", "heavy"])

    def closed(s, x, many, counts):
        first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        low, size = np.repeat(x[first], counts), np.repeat(counts, counts)
        heavy = np.repeat(np.logical_or.reduceat(many, first), counts) | (size > cap)
        keep = (size > 1) | heavy
        return out(s[keep], x[keep], low[keep], heavy[keep])

    for b in batches:
        if not b.num_rows:
            continue
        s, x = b.column(0).to_numpy(), b.column(1).to_numpy()
        many = b.column(2).to_numpy(zero_copy_only=False) if b.num_columns > 2 else np.zeros(len(s), bool)
        new = np.concatenate([[(s[0], x[0]) != (last_sig, last_set)], (s[1:] != s[:-1]) | (x[1:] != x[:-1])])
        s, x, many = s[new], x[new], many[new]
        if not len(s):
            continue
        if lo is not None:
            n = int(np.searchsorted(s != last_sig, True)) if s[0] == last_sig else 0
            if n:
                yield out(s[:n], x[:n], np.full(n, lo), np.ones(n, bool))
            last_sig, last_set = int(s[-1]), int(x[-1])
            s, x, many = s[n:], x[n:], many[n:]
            if not len(s):
                continue
            lo = None
        last_sig, last_set = int(s[-1]), int(x[-1])
        sig, sets, big = np.concatenate([sig, s]), np.concatenate([sets, x]), np.concatenate([big, many])
        edges = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        if len(edges) > 1:
            yield closed(sig[: edges[-1]], sets[: edges[-1]], big[: edges[-1]], np.diff(edges))
            sig, sets, big = sig[edges[-1] :], sets[edges[-1] :], big[edges[-1] :]
        if len(sig) > cap:
            lo = int(sets[0])
            yield out(sig, sets, np.full(len(sig), lo), np.ones(len(sig), bool))
            sig, sets, big = sig[:0], sets[:0], big[:0]
    if len(sig):
        yield closed(sig, sets, big, np.array([len(sig)]))


def _opened(texts: pa.Array) -> list[str]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(t).decode("utf-8", "surrogatepass") for t in texts.to_pylist()]


def _verified(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """a, b, ta, tb -> a, b, inter, both: the exact sizes of intersection and union."""
    for b in in_blocks(batches, "tb", 1 << 19):
        a, x = b.column(0).to_pylist(), b.column(1).to_pylist()
        left = dict(zip(a, b.column(2), strict=True))
        lsets = dict(zip(left, shingle_sets(_opened(pa.array(left.values(), pa.binary())), k), strict=True))
        inter, both = [], []
        for key, s in zip(a, shingle_sets(_opened(b.column(3)), k), strict=True):
            n = len(np.intersect1d(lsets[key], s, assume_unique=True))
            inter.append(n)
            both.append(len(lsets[key]) + len(s) - n)
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(x, pa.int64()), pa.array(inter, pa.int64()), pa.array(both, pa.int64())], ["a", "b", "inter", "both"])


def _compare(k: int, num: int, den: int):
    """applyInPandas: the sets of two blocks (side 0 and 1; a block with itself has side 0 only) -> a link for each two components."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf.side == i] for i in (0, 1)]
        if sides[1].empty:
            sides[1] = sides[0]
        sets = [shingle_sets(_opened(pa.array(x.text, pa.binary())), k) for x in sides]
        keys, comps = [x.set.to_numpy() for x in sides], [x.comp.to_numpy() for x in sides]
        flat = [np.concatenate(x) for x in sets]
        common = np.intersect1d(*flat)
        sizes = [np.array([len(s) for s in x]) for x in sets]
        inter = np.zeros((len(sets[0]), len(sets[1])), np.float32)
        for at in range(0, len(common), 4096):
            part, hot = common[at : at + 4096], []
            for x, size, f in zip(sets, sizes, flat, strict=True):
                m = np.zeros((len(x), len(part)), np.float32)
                pos = np.minimum(np.searchsorted(part, f), len(part) - 1)
                ok = part[pos] == f
                m[np.repeat(np.arange(len(x)), size)[ok], pos[ok]] = 1
                hot.append(m)
            inter += hot[0] @ hot[1].T
        inter = inter.astype(np.int64)
        both = sizes[0][:, None] + sizes[1][None, :] - inter
        i, j = np.nonzero((den * inter >= num * both) & (comps[0][:, None] != comps[1][None, :]))
        found = pd.DataFrame({"a": np.minimum(keys[0][i], keys[1][j]), "b": np.maximum(keys[0][i], keys[1][j]), "inter": inter[i, j], "both": both[i, j], "x": np.minimum(comps[0][i], comps[1][j]), "y": np.maximum(comps[0][i], comps[1][j])})
        return found.drop_duplicates(["x", "y"])[["a", "b", "inter", "both"]]

    return run


def _listed(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """set, text (compressed) -> set, least (the fewest shingles that it shares with a linked set), shingle: a row for each shingle."""
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            sets = shingle_sets(_opened(part.column(1)), k)
            lens = np.array([len(s) for s in sets], np.int64)
            yield pa.record_batch([pa.array(np.repeat(part.column(0).to_numpy(), lens)), pa.array(np.repeat(-(-num * lens // den), lens)), pa.array(np.concatenate(sets).view(np.int64))], ["set", "least", "shingle"])


def rare_groups(texts: DataFrame, k: int, num: int, den: int, cap: int) -> DataFrame:
    """The groups (sig, set, lo, heavy) of sets (set, text) by shared rare shingles: two sets that link are in one of them together."""
    rows = staged(texts.select("set", "text").mapInArrow(lambda it: _listed(it, k, num, den), "set long, least long, shingle long"), "join-shingles")
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    # The common shingle that comes first in the order of all has least - 1 others behind it in either set, at least; `often` is its count, so one of a single set needs no place.
    place = F.row_number().over(Window.partitionBy("set").orderBy(F.desc("often"), F.desc("shingle")))
    rare = staged(rows.join(often, "shingle").withColumn("place", place).where("place >= least").select(F.col("shingle").alias("sig"), "set"), "join-rare")
    shared = rare.groupBy("sig").agg(F.min("set").alias("lo"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return staged(rare.join(shared, "sig").select("sig", "set", "lo", (F.col("n") > cap).alias("heavy")), "join-groups")


def _clouds(rest: DataFrame, texts: DataFrame, k: int, num: int, den: int, block: int) -> DataFrame:
    """Links across components among sets that share large groups: rest has sig, set, comp."""
    hubs = rest.groupBy("sig").agg(F.min("set").alias("hub"))
    # A set hangs on its least hub, and its other hubs hang on that one: few different links carry what all memberships do.
    on = staged(rest.join(hubs, "sig").select("set", "hub").distinct(), "join-hubs")
    least = on.groupBy("set").agg(F.min("hub").alias("least"))
    chain = on.join(least, "set").select(F.col("hub").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
    cloud = components(least.select(F.col("set").alias("a"), F.col("least").alias("b")).unionByName(chain))
    rows = staged(rest.select("set", "comp").distinct().join(cloud.select(F.col("node").alias("set"), F.col("comp").alias("cloud")), "set"), "join-cloud")
    sizes = rows.groupBy("cloud", "comp").agg(F.count(F.lit(1)).alias("n"))
    pool = sizes.withColumn("own", F.when(F.col("n") >= block, F.col("comp"))).groupBy("cloud", "own").agg(F.ceil(F.sum("n") / block).cast("long").alias("blocks"))
    own = sizes.select("cloud", "comp", F.when(F.col("n") >= block, F.col("comp")).alias("own"))
    of = own.join(pool, (own["cloud"] == pool["cloud"]) & own["own"].eqNullSafe(pool["own"])).select(own["cloud"], own["comp"], own["own"], "blocks")
    dealt = staged(rows.join(of, ["cloud", "comp"]).select("set", "comp", "cloud", "own", F.pmod(F.xxhash64("set"), "blocks").alias("no")), "join-dealt")
    blocks = dealt.select("cloud", "own", "no").distinct()
    blocks = staged(blocks.withColumn("block", F.xxhash64("cloud", "own", "no")), "join-blocks")
    one, two = blocks.select("cloud", F.col("own").alias("o1"), F.col("block").alias("b1")), blocks.select("cloud", F.col("own").alias("o2"), F.col("block").alias("b2"))
    pairs = staged(one.join(two, "cloud").where("b1 <= b2 and not coalesce(o1 = o2, false)").select("b1", "b2", F.xxhash64("b1", "b2").alias("pair")), "join-block-pairs")
    named = dealt.withColumn("block", F.xxhash64("cloud", "own", "no")).select("set", "comp", "block").join(texts, "set")
    left = named.join(pairs.select(F.col("b1").alias("block"), "pair"), "block").withColumn("side", F.lit(0))
    right = named.join(pairs.where("b1 <> b2").select(F.col("b2").alias("block"), "pair"), "block").withColumn("side", F.lit(1))
    got = left.unionByName(right).select("pair", "side", "set", "comp", "text").groupBy("pair").applyInPandas(_compare(k, num, den), "a long, b long, inter long, both long")
    return staged(got, "join-verified")


PARTS = 256


def _sketched(batches: Iterator[pa.RecordBatch], k: int, signed: Scheme | None) -> Iterator[pa.RecordBatch]:
    """set, text -> set, n, spare (see signatures; 1 without a scheme), sketch (elements per part of the domain, a byte each, at most 255), text (compressed)."""
    pack = zstandard.ZstdCompressor(level=3)
    for b in in_blocks(batches, "text", 1 << 20):
        texts = b.column(1).to_pylist()
        sets = shingle_sets(texts, k)
        rows = [np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes() for s in sets]
        yield pa.record_batch([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(signatures(sets, signed, True)[2] if signed else np.ones(len(sets), np.int64)), pa.array(rows, pa.binary()), pa.array([pack.compress(t.encode("utf-8", "surrogatepass")) for t in texts], pa.binary())], ["set", "n", "spare", "sketch", "text"])
        pa.default_memory_pool().release_unused()


def _near_enough(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    """a, b, na, nb, sa, sb -> a, b whose sketches allow a link: sets differ in no fewer elements than their parts' counts do."""
    for b in batches:
        if not b.num_rows:
            continue
        one, two = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int16) for i in (4, 5))
        total = b.column(2).to_numpy() + b.column(3).to_numpy()
        allowed = total - 2 * -(-scheme.num * total // (scheme.num + scheme.den))
        yield b.select([0, 1]).filter(pa.array(np.abs(one - two).sum(axis=1) <= allowed))


def grouped(src: DataFrame, signed: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], cap: int) -> DataFrame:
    """The groups (sig, set, lo, heavy) of the rows (sig, set) that `signed` gives, as Settled does."""
    buckets = BUCKETS * int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("sig", pa.int64()), ("set", pa.int64()), ("lo", pa.int64()), ("heavy", pa.bool_())])
    packs = src.mapInArrow(lambda it: dealt(signed(it), buckets), "bucket int, body binary")
    groups = packs.groupBy("bucket").applyInArrow(lambda t: pa.Table.from_batches(_bucket_groups(t.column("body").to_pylist(), cap), schema), "sig long, set long, lo long, heavy boolean")
    return staged(groups, "join-groups")


def group_links(src: DataFrame, members: DataFrame, groups: DataFrame, scheme: Scheme, k: int, cap: int, block: int, broadcast_bytes: int, enumerated: bool = False) -> tuple[DataFrame, DataFrame]:
    """Verified links between sets of one group (a, b, inter, both), enough of them for the components, and comps (node, comp) of the linked sets. src has rk and text, members rk, set and n. enumerated: the groups are those of the scheme's signatures; else a set could owe a link to any one large group."""
    num, den = scheme.num, scheme.den
    sizes = members.where("n > 0").groupBy("set").agg(F.min("rk").alias("rk"))
    needed = staged(groups.select("set").distinct().join(sizes, "set"), "join-needed")
    small = needed.count() * 16 <= broadcast_bytes
    texts = src.select("rk", "text").join(F.broadcast(needed.select("rk", "set")) if small else needed.select("rk", "set"), "rk").select("set", "text")
    packed = texts.mapInArrow(lambda it: _sketched(it, k, scheme if enumerated else None), "set long, n long, spare long, sketch binary, text binary")
    sketches = staged(packed.groupBy("set").agg(F.first(F.struct("n", "spare", "sketch", "text")).alias("x")).select("set", "x.*"), "join-sketches")
    texts = sketches.select("set", "text")

    def only(sets: DataFrame) -> DataFrame:
        """texts of the sets given, so that no others go through an exchange; their keys are broadcast within the bound."""
        wanted = staged(sets.distinct(), "join-wanted")
        return texts.join(F.broadcast(wanted) if wanted.count() * 16 <= broadcast_bytes else wanted, "set", "left_semi")

    def verify(pairs: DataFrame) -> DataFrame:
        """pairs (a, b) whose sizes and sketches allow a link, compared exactly."""
        at = {c: sketches.select(F.col("set").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in ("a", "b")}
        sized = pairs.distinct().join(at["b"], "b").join(at["a"], "a").where(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
        likely = staged(sized.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lambda it: _near_enough(it, scheme), "a long, b long"), "join-likely")
        asked = only(likely.select(F.explode(F.array("a", "b")).alias("set")))
        one, two = (asked.select(F.col("set").alias(c), F.col("text").alias(f"t{c}")) for c in ("a", "b"))
        full = likely.join(two, "b").join(one, "a")
        return staged(full.select("a", "b", "ta", "tb").mapInArrow(lambda it: _verified(it, k), "a long, b long, inter long, both long"), "join-verified")

    def linked(done: DataFrame) -> DataFrame:
        return done.where(den * F.col("inter") >= num * F.col("both"))

    def placed(rows: DataFrame, comps: DataFrame) -> DataFrame:
        """rows with each set's component."""
        return rows.join(comps.select(F.col("node").alias("set"), "comp"), "set", "left").withColumn("comp", F.coalesce("comp", "set"))

    def mixed(at: DataFrame) -> DataFrame:
        """Groups that hold several components still."""
        return at.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("sig")

    def across(rows: DataFrame) -> DataFrame:
        """Pairs of one group and of different components."""
        one, two = rows.select("sig", F.col("set").alias("a"), F.col("comp").alias("ca")), rows.select("sig", F.col("set").alias("b"), F.col("comp").alias("cb"))
        return one.join(two, "sig").where("a < b and ca <> cb").select("a", "b")

    done = verify(groups.where("set <> lo").select(F.col("lo").alias("a"), F.col("set").alias("b")))
    comps = components(linked(done))
    at = placed(groups.where("not heavy"), comps)
    light = staged(at.join(mixed(at), "sig", "left_semi"), "join-apart")
    if not light.isEmpty():
        done = done.unionByName(verify(across(light)))
        comps = components(linked(done))
    # A set with `spare` large groups or more could owe a link to those alone.
    owing = groups.where("heavy").groupBy("set").agg(F.count(F.lit(1)).alias("large")).join(sketches.select("set", "spare"), "set").where("large >= spare").select("set")
    large = staged(groups.where("heavy").join(owing, "set", "left_semi"), "join-large")
    at = placed(large, comps)
    open_groups = staged(mixed(at), "join-mixed")
    if not open_groups.isEmpty():
        for _ in range(2):  # a hot signature's groups of one block, and of one task, hang on its open one by their least set
            below = large.join(large.join(open_groups, "sig", "left_semi").select(F.col("set").alias("lo")).distinct(), "lo", "left_semi").select("sig")
            open_groups = staged(open_groups.unionByName(below).distinct(), "join-mixed")
        rest = staged(at.join(open_groups, "sig", "left_semi").select("sig", "set", "comp"), "join-apart")
        at = placed(rare_groups(only(rest.select("set")), k, num, den, cap), comps)
        apart = staged(at.join(mixed(at), "sig", "left_semi"), "join-apart")
        done = done.unionByName(verify(across(apart.where("not heavy")).unionByName(apart.where("heavy and set <> lo").select(F.col("lo").alias("a"), F.col("set").alias("b")))))
        comps = components(linked(done))
        at = placed(apart.where("heavy").drop("comp"), comps)
        rest = staged(at.join(mixed(at), "sig", "left_semi").select("sig", "set", "comp"), "join-apart")
        if not rest.isEmpty():
            done = done.unionByName(_clouds(rest, only(rest.select("set")), k, num, den, block))
            comps = components(linked(done))
    return linked(done), comps


def similarity_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, num: int = 80, den: int = 100, slack: float = 1.0, cap: int = CAP, block: int = 512, broadcast_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members (rk, id, set, n), verified links between sets (a, b, inter, both), and comps (node, comp) of the linked sets."""
    scheme = Scheme(num, den, slack)
    small_batches(docs.sparkSession)
    src = keyed(docs, id_col, text_col)
    kind = dict(src.dtypes)["id"]
    members = staged(src.mapInArrow(lambda it: _members(it, k), f"rk long, id {kind}, set long, n long"), "join-members")
    groups = grouped(src.select("text"), lambda it: _signed(it, k, scheme, cap), cap)
    return members, *group_links(src, members, groups, scheme, k, cap, block, broadcast_bytes, enumerated=True)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rk (a hash of the row's id and text), id, text."""
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).select(F.xxhash64("id", "text").alias("rk"), "id", "text")


def component_ids(members: DataFrame, comps: DataFrame, id_col: str) -> DataFrame:
    """Per row of members: id, n_shingles, component_id."""
    sets = members.where("n > 0").groupBy("set").agg(F.min("id").alias("least"))
    at = sets.join(comps.select(F.col("node").alias("set"), "comp"), "set", "left").withColumn("comp", F.coalesce("comp", "set"))
    least = at.groupBy("comp").agg(F.min("least").alias("component_id"))
    of = staged(at.join(least, "comp").select("set", "component_id"), "join-classes")
    out = members.join(of, "set", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id."""
    members, _, comps = similarity_links(docs, id_col, text_col, **options)
    return component_ids(members, comps, id_col)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir))
