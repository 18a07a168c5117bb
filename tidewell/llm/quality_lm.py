"""Quality by an interpolated modified Kneser-Ney n-gram model of characters.

Training: trusted texts (label 1, all of them, none sampled) give n-gram counts, folded
per block and summed by shards of the n-gram. Discounts come from counts of counts; the
probabilities of each order come from joins of its counts with the sums of their contexts
and with the next lower order. Neither the characters nor the n-grams are limited: the model
grows with its input. It is a staged table of 64-bit keys and values: the probability of each n-gram
seen, of all orders, and the back-off weight of each context.

Scoring: texts are read in blocks, and a block asks for its distinct n-grams of the highest
order only. The distinct n-grams of all blocks are joined with the model's shards: first by
themselves, and only those never seen go on to the contexts and the lower orders, down to the
first order found. The probabilities found return to the blocks by an equi-join on the n-gram's 64-bit key, so that
no task holds more than one block and its answers. The `hot` most frequent n-grams of the training texts,
which nearly every block would ask for, are a broadcast table of that fixed size; so are the
`hot` contexts and n-grams of lower orders that most n-grams lead to, so that no key of
either join is hot. With `broadcast_bytes` above 0 a model within that counted size
is looked up in a sorted copy instead; both ways give the same figures.

Cross-fit: trusted texts are dealt into `folds` by crc32(id); a document, trusted or not, is
scored by the model of the trusted texts of the other folds, so no text is judged by its own
counts, and the perplexities of all trusted texts make the thresholds.

A text's perplexity is per character, smoothed towards the trusted mean by `prior`
characters so that short texts aren't judged by a few letters. The threshold of a language
is the `quantile` of its trusted texts; languages with fewer than `min_rows`
such texts use the threshold of all. Texts above are rejected.

Defined results: null and empty texts get the trusted mean and are accepted; a null
language is a language of its own; without trusted text all is accepted with a null
perplexity; a null id is of fold 0; where a fold's others hold no text, the model of all
trusted texts scores it. Repeated rows are scored row by row, also where an id has several
texts or labels (one label 1 makes all its texts trusted); an empty table gives an empty
result; other columns, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

import dataclasses
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_blocks, documents, packed, row_key, scratch, staged, table, unpacked, without

#: Characters of an n-gram, bytes of text counted at once, scored at once and asking together, and the n-grams that are broadcast.
ORDER, COUNT, BLOCK, ASK, HOT = 5, 1 << 20, 1 << 19, 8 << 20, 1 << 18
#: What stands before a text; a text's own, and its zeros, are read as U+FFFD.
PAD = "\x03"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _times(n: int, power: int = 1) -> np.uint64:
    """n times a power of the step, modulo 2^64."""
    return np.uint64(n * int(_STEP) ** power % 2**64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _key(code: np.ndarray, order: int, context: bool) -> np.ndarray:
    """Keys in the model of n-grams, or of contexts, by their rolling codes."""
    return _mix(code + _times(2 * order + context)).view(np.int64)


def _points(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, order - 1 pads before each; the positions of the texts' characters; and the texts' lengths."""
    pad = PAD * (order - 1)
    texts = [t.replace("\x00", "�").replace(PAD, "�") if t else "" for t in texts]
    joined = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.array([len(t) for t in texts], np.int64)
    heads = np.cumsum(lens + order - 1) - lens
    return joined, np.arange(lens.sum()) + np.repeat(heads - (np.cumsum(lens) - lens), lens), lens


def _distinct(joined: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One position of each distinct n-gram that ends at one of `at`, which of these stands at each of `at`, and their rolling codes."""
    value = _mix(joined.astype(np.uint64) + _STEP)
    code = value.copy()
    for i in range(1, order):
        code[i:] += value[:-i] * _times(1, i)
    which = pa.array(code[at]).dictionary_encode()
    which, codes = which.indices.to_numpy(), which.dictionary.to_numpy()
    where = np.zeros(len(codes), np.int64)
    where[which] = at
    return where, which, codes


def _codes(joined: np.ndarray, where: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..order the rolling codes of the n-grams that end at `where` and of their contexts."""
    code, context = np.zeros(len(where), np.uint64), np.zeros(len(where), np.uint64)
    for i in range(order):
        value = _mix(joined[where - i].astype(np.uint64) + _STEP)
        code = code + value * _times(1, i)
        if i:
            context = context + value * _times(1, i - 1)
        yield code, context


class _Index:
    """Where 64-bit keys stand among given ones. A table is addressed by a key's upper bits; of keys that share a slot one stays, the others go on to the next table, whose bits are others."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.tables = keys, []
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            self.tables.append(np.full(2 << len(left).bit_length(), -1, np.int32))
            slots = self._slots(keys[left], len(self.tables) - 1)
            self.tables[-1][slots] = left
            left = left[self.tables[-1][slots] != left]

    def _slots(self, keys: np.ndarray, level: int) -> np.ndarray:
        return (keys.view(np.uint64) * _times(1, level)) >> np.uint64(65 - len(self.tables[level]).bit_length())

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those that aren't there."""
        out, left = np.full(len(keys), -1, np.int32), np.arange(len(keys))
        for level, table in enumerate(self.tables):
            at = table[self._slots(keys, level)]
            same = (at >= 0) & (self.keys[at] == keys)
            out[left[same]] = at[same]
            on = (at >= 0) & ~same  # an empty slot ends the search: no key went past it
            left, keys = left[on], keys[on]
        return out


@dataclasses.dataclass
class Model:
    """A table of keys and values, its counted rows, the probability of a character never seen, the characters seen, the most frequent n-grams of the highest order and the most frequent n-grams and contexts of the lower ones (key, value)."""

    order: int
    rows: DataFrame
    size: int
    floor: float
    chars: int
    hot: DataFrame | None = None
    low: DataFrame | None = None

    @functools.cached_property
    def shared(self):
        """A broadcast of the sorted keys and their values; for models of a checked size only."""
        got = self.rows.toArrow()
        keys, values = got.column("key").to_numpy(), got.column("value").to_numpy()
        by = np.argsort(keys)
        return self.rows.sparkSession.sparkContext.broadcast((keys[by], values[by]))


def _common(rows: DataFrame):
    """A broadcast of the keys and values of a table of a counted bound."""
    got = rows.toArrow()
    keys = pa.concat_arrays([pa.array([], pa.int64()), *got.column("key").chunks]).to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast((keys, got.column("value").to_numpy().astype(np.float64)))
    del got
    pa.default_memory_pool().release_unused()
    return shared


def _bits(texts: list[str | None], order: int, floor: float, known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits and characters of each text; `known` is sorted."""

    def look(keys: np.ndarray, default) -> np.ndarray:
        if not len(known):
            return np.full(len(keys), default)
        by = np.argsort(keys)  # neighbouring look-ups stay near each other in the table
        out, keys = np.empty(len(keys)), keys[by]
        i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        out[by] = np.where(known[i] == keys, values[i], default)
        return out

    joined, at, lens = _points(texts, order)
    where, which, _ = _distinct(joined, at, order)
    p, left = np.ones(len(where)), np.arange(len(where))
    for n in range(order, 0, -1):  # only n-grams never seen go on to the next lower order
        *_, (code, context) = _codes(joined, where[left], n)
        seen = look(_key(code, n, False), np.nan)
        hit = ~np.isnan(seen)
        p[left[hit]] *= seen[hit]
        left = left[~hit]
        if n > 1:
            p[left] *= look(_key(context[~hit], n, True), 1.0)
    p[left] *= floor
    return _summed(p, which, lens)


def _summed(p: np.ndarray, which: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits and characters of each text from the probabilities of the distinct n-grams, which of these stand where, and the texts' lengths."""
    sums = np.concatenate([[0.0], np.cumsum(-np.log2(np.maximum(p, 1e-12))[which])])
    ends = np.cumsum(lens)
    return sums[ends] - sums[ends - lens], lens


def _strings(joined: np.ndarray, where: np.ndarray, order: int) -> pa.Array:
    """The n-grams that end at `where`."""
    return pa.array(joined[where[:, None] - np.arange(order - 1, -1, -1)].view(f"<U{order}").ravel(), pa.string())


def _counts(docs: DataFrame, order: int) -> DataFrame:
    """The n-grams of docs.text, as strings that start with pads before a text, and how often they occur."""

    def block(b: pa.RecordBatch) -> pa.RecordBatch:
        joined, at, _ = _points(b.column(0).to_pylist(), order)
        where, which, _ = _distinct(joined, at, order)
        return pa.record_batch([_strings(joined, where, order), pa.array(np.bincount(which, minlength=len(where)), pa.int64())], ["gram", "n"])

    return by_blocks(docs, block, "gram string, n long", limit=COUNT).groupBy("gram").agg(F.sum("n").alias("n"))


def _keyed(df: DataFrame, order: int, length: int, context: bool) -> DataFrame:
    """Rows (gram, another column), whose grams have `length` characters, with the gram's key in its place."""
    name, kind = df.dtypes[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            joined = np.frombuffer("".join(b.column(0).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
            *_, (code, _) = _codes(joined, np.arange(length - 1, len(joined), length), length)
            yield pa.record_batch([pa.array(_key(code, order, context)), b.column(1)], ["key", name])

    return df.mapInArrow(run, f"key long, {name} {kind}")


def _most(rows: DataFrame, n: int) -> DataFrame:
    """The rows of the greatest column n, cut where a count of counts says that no more than n are left."""
    step = F.floor(F.log2("n") * 8)
    left, cut = n, None
    for r in sorted(rows.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):
        left -= r["count"]
        if left < 0:
            break
        cut = r.step
    return rows.where(step >= cut if cut is not None else F.lit(False))


def train(trusted: DataFrame, text_col: str = "text", order: int = ORDER, hot: int = HOT) -> Model | None:
    """The model of all trusted texts; None if they hold no character."""
    src = trusted.select(trusted[text_col].alias("text"))
    grams = [staged(_counts(src, order), "lm-grams")]
    for _ in range(order - 1):  # lower orders count the distinct characters before them
        grams.append(staged(grams[-1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n")), "lm-grams"))
    grams.reverse()
    tallies = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]
    sizes = functools.reduce(DataFrame.unionByName, [g.select(F.lit(n).alias("order"), "n") for n, g in enumerate(grams, 1)])
    sizes = {r.order: r for r in sizes.groupBy("order").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total"), *tallies).collect()}
    if not sizes:
        return None
    lower, parts, probs, floor, chars = None, [], [], 1.0, sizes[1].rows + 1
    for n, counts in enumerate(grams, 1):
        n1, n2, n3, n4 = (sizes[n][f"n{i}"] for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = [max(0.05, min(i - 0.05, i - (i + 1) * y * b / a)) if a and b else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        rows = counts.select("gram", F.col("n").cast("double").alias("n"), cut.alias("cut"), F.expr(f"substring(gram, 1, {n - 1})").alias("context"), F.expr("substring(gram, 2)").alias("suffix"))
        contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("mass")).withColumn("gamma", F.col("mass") / F.col("total"))
        if lower is None:
            floor = (d[0] * n1 + d[1] * n2 + d[2] * (sizes[1].rows - n1 - n2)) / sizes[1].total / chars
            p = rows.select("gram", "n", ((F.col("n") - F.col("cut")) / sizes[1].total + floor).alias("p"))
        else:
            joined = rows.join(contexts, "context").join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
            p = joined.select("gram", "n", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("gamma") * F.col("below")).alias("p"))
            parts.append(_keyed(contexts.select("context", F.col("gamma").cast("float").alias("value")), n, n - 1, True))
        lower = staged(p, "lm-probs")
        probs.append(lower)
        parts.append(_keyed(lower.select("gram", F.col("p").cast("float").alias("value")), n, n, False))
    rows = staged(functools.reduce(DataFrame.unionByName, parts), "lm-model")
    most = _most(lower, hot).select("gram", F.col("p").cast("float").alias("value"))
    most = staged(_keyed(most, order, order, False), "lm-hot")
    low = None
    if order > 1:  # half of the keys are n-grams, half the contexts that they are
        leading = _most(functools.reduce(DataFrame.unionByName, [g.select("gram", "n", F.lit(n).alias("length")) for n, g in enumerate(probs[:-1], 1)]), hot // 2)
        leading = staged(leading.select("gram", "length"), "lm-leading")
        keys = [_keyed(leading.where(F.col("length") == n), n + context, n, bool(context)).select("key") for n in range(1, order) for context in (0, 1)]
        low = staged(rows.join(F.broadcast(functools.reduce(DataFrame.unionByName, keys)), "key", "left_semi"), "lm-low")
    return Model(order, rows, rows.count(), floor, chars, most, low)


def _gram_keys(grams: list[str], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The model's keys of the n-grams, and those to go on with: context, next lower order, its context, and so on."""
    joined = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = list(_codes(joined, np.arange(order - 1, len(joined), order), order))
    rest = []
    for n in range(order, 0, -1):
        code, context = codes[n - 1]
        if n < order:
            rest.append(_key(code, n, False))
        if n > 1:
            rest.append(_key(context, n, True))
    return _key(codes[-1][0], order, False), rest


def _resolved(grams: DataFrame, model: Model) -> DataFrame:
    """key and p of distinct n-grams of the highest order, by joins with the model's shards."""
    order, slots = model.order, 2 * model.order - 2
    first = staged(_keyed(grams.select("gram", F.col("gram").alias("said")), order, order, False).join(model.rows, "key", "left"), "lm-first")
    seen = first.where("value is not null").select("key", F.col("value").cast("double").alias("p"))
    if not slots:
        return first.select("key", F.coalesce(F.col("value").cast("double"), F.lit(model.floor)).alias("p"))
    low = _common(model.low)  # HOT rows at most

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leading = _Index(low.value[0])
        for b in batches:
            if not b.num_rows:
                continue
            _, keys = _gram_keys(b.column(1).to_pylist(), order)
            known, asked = np.full((b.num_rows, slots), np.nan), np.zeros((b.num_rows, slots), bool)
            open_ = np.arange(b.num_rows)
            for i, key in enumerate(keys):
                at = leading.find(key[open_])
                hit = at >= 0
                known[open_[hit], i] = low.value[1][at[hit]]
                asked[open_[~hit], i] = True
                if i % 2:  # an n-gram, not a context: nothing below one that was seen is needed
                    open_ = open_[~hit]
            ends = np.concatenate([[0], np.cumsum(asked.sum(1))]).astype(np.int32)
            which, own = np.nonzero(asked)[1].astype(np.int32), np.stack(keys, 1)[asked]
            asks = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(which), pa.array(own)], ["slot", "own"]))
            yield pa.record_batch([b.column(0), *(pa.array(known[:, i], mask=np.isnan(known[:, i])) for i in range(slots)), asks], ["key", *values, "asks"])

    values = [f"v{i}" for i in range(slots)]
    left = first.where("value is null").select("key", "said").mapInArrow(rest, f"key long, {', '.join(f'{v} double' for v in values)}, asks array<struct<slot:int,own:long>>")
    left = staged(left, "lm-rest")
    found = left.select("key", F.inline("asks")).join(model.rows.select(F.col("key").alias("own"), "value"), "own")
    found = found.select("key", *[F.when(F.col("slot") == i, F.col("value").cast("double")).alias(v) for i, v in enumerate(values)])
    wide = left.where("size(asks) > 0").select("key", *values).unionByName(found).groupBy("key").agg(*[F.max(v).alias(v) for v in values])
    p = F.lit(model.floor)
    for n in range(1, order):  # at slots from the end: order 1, context of 2, order 2, context of 3, ...
        at = 2 * (order - n) - 1
        p = F.coalesce(F.col(f"v{at - 1}"), F.lit(1.0)) * F.coalesce(F.col(f"v{at}"), p)
    return seen.unionByName(left.where("size(asks) = 0").select("key", p.alias("p"))).unionByName(wide.select("key", p.alias("p")))


def tallied(src: DataFrame, model: Model, broadcast_bytes: int = 0) -> DataFrame:
    """From rows with a column `text` and others: the others, lm_bits (of the whole text) and lm_chars. The texts themselves don't come back."""
    order, floor = model.order, model.floor
    others = [c for c in src.columns if c != "text"]
    kinds = dict(src.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "lm_bits double", "lm_chars long"])

    def scored(b: pa.RecordBatch, bits: np.ndarray, lens: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([*(b.column(c) for c in others), pa.array(bits), pa.array(lens)], [*others, "lm_bits", "lm_chars"])

    if model.size * 12 <= broadcast_bytes:
        shared = model.shared
        return by_blocks(src, lambda b: scored(b, *_bits(b.column("text").to_pylist(), order, floor, *shared.value)), schema, limit=BLOCK)
    common = _common(model.hot)  # HOT rows at most
    blocks = staged(packed(src, "text", ASK), "lm-blocks")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = _Index(common.value[0])
        for b in batches:
            for block, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                keys, grams = [np.array([], np.int64)], [pa.array([], pa.string())]
                for part in unpacked(body, "text", BLOCK):
                    joined, at, _ = _points(part.column("text").to_pylist(), order)
                    where, _, codes = _distinct(joined, at, order)
                    key = _key(codes, order, False)
                    rare = hot.find(key) < 0
                    keys.append(key[rare])
                    grams.append(_strings(joined, where[rare], order))
                which = pa.array(np.concatenate(keys)).dictionary_encode()
                once = np.zeros(len(which.dictionary), np.int64)  # a place of each key
                once[which.indices.to_numpy()] = np.arange(len(which))
                wanted = pa.concat_arrays(grams).take(pa.array(once))
                yield pa.record_batch([pa.array(np.full(len(wanted), block, np.int64)), wanted], ["block", "gram"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, none = _Index(common.value[0]), np.array([], np.int64)
        for b in batches:
            for body, pairs in zip(b.column(0), b.column(1), strict=True):
                own, known = none, np.array([])
                if pairs.is_valid:
                    own, known = pairs.values.field(0).to_numpy(), pairs.values.field(1).to_numpy()
                own = _Index(own)
                for part in unpacked(body, "text", BLOCK):
                    joined, at, lens = _points(part.column("text").to_pylist(), order)
                    _, which, codes = _distinct(joined, at, order)
                    keys = _key(codes, order, False)
                    found = hot.find(keys)
                    rare = np.flatnonzero(found < 0)
                    asked = own.find(keys[rare])
                    if (asked < 0).any():
                        raise ValueError("an n-gram of a block has no answer")
                    p = np.empty(len(keys))
                    p[rare] = known[asked]
                    p[found >= 0] = common.value[1][found[found >= 0]]
                    yield scored(part, *_summed(p, which, lens))

    asked = staged(blocks.mapInArrow(ask, "block long, gram string"), "lm-asked")
    resolved = _resolved(asked.select("gram").distinct(), model)
    asking = _keyed(asked.select("gram", "block"), order, order, False)
    answers = asking.join(resolved, "key").groupBy("block").agg(F.collect_list(F.struct("key", "p")).alias("pairs"))
    return blocks.join(answers, "block", "left").select("body", "pairs").mapInArrow(answer, schema)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", quantile: float = 0.998, min_rows: int = 20, folds: int = 2, prior: float = 200.0, order: int = ORDER, broadcast_bytes: int = 0, label_bytes: int = 64 << 20) -> DataFrame:
    """Per row of docs, without its text: id, lang, key (the row's own, see row_key), perplexity, threshold, accepted. The trusted ids are broadcast while counted within `label_bytes`."""
    key = row_key(docs[id_col], docs[lang_col], docs[text_col])
    src = docs.select(docs[id_col].alias("id"), docs[lang_col].alias("lang"), key.alias("key"), docs[text_col].alias("text"))
    good = staged(labels.select(labels[id_col].alias("id"), labels[label_col].alias("label")).where("label = 1 and id is not null").select("id").distinct(), "lm-good")
    good = F.broadcast(good) if good.count() * 16 <= label_bytes else good
    fold = F.coalesce(F.crc32(F.col("id").cast("string")) % folds, F.lit(0))
    trusted = src.join(good, "id", "left_semi").select("id", "text")
    parts, chars = [], 1
    for f in range(folds):
        made: list[DataFrame] = []
        with scratch(src.sparkSession, lambda: made):  # noqa: B023  used at once
            model = train(trusted.where(fold != f).select("text"), order=order) or train(trusted.select("text"), order=order)
            if model is None:
                nothing = F.lit(None).cast("double")
                return src.select("id", "lang", "key", nothing.alias("perplexity"), nothing.alias("threshold"), F.lit(True).alias("accepted"))
            made.append(staged(tallied(src.where(fold == f), model, broadcast_bytes), "lm-tallied"))
            chars = model.chars
        parts += made
    scored = functools.reduce(DataFrame.unionByName, parts)
    held = scored.join(good, "id", "left_semi")
    sums = held.agg(F.sum("lm_bits").alias("b"), F.sum("lm_chars").alias("c")).first()
    mean = sums.b / sums.c if sums.c else math.log2(chars) / 2
    perplexity = F.pow(F.lit(2.0), (F.col("lm_bits") + prior * mean) / (F.col("lm_chars") + prior))
    seen = held.select("lang", perplexity.alias("p"))
    at = F.percentile_approx("p", F.lit(quantile), F.lit(10_000))
    overall = seen.agg(at.alias("overall")).first().overall
    limits = staged(seen.groupBy("lang").agg(at.alias("own"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows).select(F.col("lang").alias("of"), "own"), "lm-limits")
    limits = F.broadcast(limits) if limits.count() <= 10_000 else limits
    joined = scored.join(limits, F.col("lang").eqNullSafe(F.col("of")), "left")
    limit = F.coalesce(F.col("own"), F.lit(overall).cast("double"), F.lit(float("inf")))
    return joined.select("id", "lang", "key", perplexity.alias("perplexity"), limit.alias("threshold")).withColumn("accepted", F.col("perplexity") <= F.col("threshold"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Per row of docs: id, lang, perplexity, threshold, accepted."""
    out = judged(docs, labels, id_col, text_col, lang_col, **options)
    return out.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), "perplexity", "threshold", "accepted")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of docs that aren't rejected, with its columns. Only keys of rejected rows meet the texts again."""
    out = judged(docs, labels, id_col, text_col, lang_col, **options)
    return without(docs, row_key(docs[id_col], docs[lang_col], docs[text_col]), out.where("not accepted").select(F.col("key").alias("gone")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
