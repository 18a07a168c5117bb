"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs to Latin letters and undoes digit and sign
substitutions inside words. The lexicon holds word beginnings (whole words included)
whose smoothed log-odds for the toxic label are high; it is learned from at most
`sample_rows` labelled rows, the bound on what the driver sees, taken by a hash of the
id. Phrases (a hit with the word before or after it) that occur in clean texts only
become exceptions and cancel their hit. Two features, the weight of all hits and that
weight per thousand words, go through a logistic fit.

Defined results: null and empty texts have no hits and get the intercept's score; a
null id counts as held out; without usable labels (none, or one class only) every score
is the smoothed share of toxic labels. Repeated rows are scored row by row; of labels of one
id that differ the toxic one counts. An empty table gives an empty result; other columns,
whatever their names, are ignored. Word beginnings have 3 to 10 letters.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_blocks, documents, table

#: Look-alikes of Latin letters (Cyrillic, Greek, full-width) and usual substitutions. Digits and signs count only inside a word that has letters.
HOMOGLYPHS = {**dict(zip("авеікмнорстухѕјԁɡ", "abeikmhopctyxsjdg", strict=True)), **dict(zip("αβεικνορτυχ", "abeikvoptux", strict=True)), **{chr(0xFF41 + i): chr(97 + i) for i in range(26)}}
DIGITS = str.maketrans("01345789@$", "oieastbgas")
_FOLD = str.maketrans(HOMOGLYPHS)
_SUBST = re.compile(r"[013457-9@$](?=[0-9@$]{0,3}[^\W\d_])")
_MIXED = re.compile(r"(?=[0-9@$]{0,3}[^\W\d_])(?:[^\W\d_]|[0-9@$](?=[0-9@$]{0,3}[^\W\d_]))+")


def fold(text: str | None) -> str:
    low = (text or "").lower()
    if not low.isascii():
        low = low.translate(_FOLD)
    return _MIXED.sub(lambda m: m.group() if m.group().isalpha() else m.group().translate(DIGITS), low) if _SUBST.search(low) else low


_TOKEN = re.compile(r"[^\W\d_]+")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


class Lexicon:
    """terms: word beginnings to weights; exceptions: phrases 'a b' of folded words; coef: intercept and two slopes."""

    def __init__(self, terms: dict[str, float], exceptions: set[str], coef: tuple[float, float, float]):
        self.terms, self.exceptions, self.coef = terms, exceptions, coef
        self._auto = None

    def __getstate__(self):
        return self.terms, self.exceptions, self.coef

    def __setstate__(self, state):
        self.__init__(*state)

    def hits(self, text: str):
        """(term, phrase before, phrase after) of each word that begins with a term; of several terms in one word the longest counts."""
        if self._auto is None:
            self._auto = ahocorasick.Automaton()
            for t in self.terms:
                self._auto.add_word(t, t)
            self._auto.make_automaton()
        if not self.terms:
            return
        best: dict[int, str] = {}
        for end, term in self._auto.iter(text):
            start = end + 1 - len(term)
            if not (start and text[start - 1].isalpha()) and len(term) > len(best.get(start, "")):
                best[start] = term
        for start, term in best.items():
            m = _TOKEN.match(text, start)
            before = _TOKEN.findall(text[max(0, start - 40) : start])
            after = _TOKEN.search(text, m.end(), m.end() + 40)
            yield term, f"{before[-1] if before else ''} {m.group()}", f"{m.group()} {after.group() if after else ''}"

    def features(self, text: str | None) -> tuple[float, float]:
        low = fold(text)
        weight = sum(self.terms[t] for t, a, b in self.hits(low) if a not in self.exceptions and b not in self.exceptions)
        return self._scale(weight, low)

    @staticmethod
    def _scale(weight: float, low: str) -> tuple[float, float]:
        if weight <= 0:
            return 0.0, 0.0
        return math.log1p(weight), math.log1p(1000 * weight / (low.count(" ") + low.count("\n") + 50))

    def score(self, text: str | None) -> float:
        x, y = self.features(text)
        z = self.coef[0] + self.coef[1] * x + self.coef[2] * y
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Logistic fit by Newton steps with a ridge on the slopes."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    pen = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pen, a.T @ (y - p) - pen @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def _cover(toxic: list[set[str]], terms: dict[str, float], min_gain: int) -> dict[str, float]:
    """Terms that, taken greedily, explain at least min_gain toxic texts no term before explains: words that merely share copied toxic texts go."""
    holders: dict[str, set[int]] = {}
    for i, found in enumerate(toxic):
        for t in found:
            holders.setdefault(t, set()).add(i)
    kept, covered = {}, set()
    for t in sorted(holders, key=lambda t: (-len(holders[t]) * terms[t], t)):
        if len(holders[t] - covered) >= min_gain or len(holders[t]) >= 0.1 * len(toxic):
            kept[t] = terms[t]
            covered |= holders[t]
    return kept


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 20_000, min_docs: int = 4, min_odds: float = 3.0, min_gain: int = 3, lengths: tuple[int, int] = (3, 10), seed: int = 0) -> Lexicon:
    """Lexicon, exceptions and coefficients from labelled rows whose crc32(id) mod 5 isn't 0, at most sample_rows of them."""
    lab = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where(~held_out(F.col("id")) & F.col("y").isin(0, 1)).groupBy("id").agg(F.max("y").alias("y"))
    lab = lab.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample_rows)
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(lab), "id").select("y", "text")
    low, high = lengths

    def prefixes(b: pa.RecordBatch) -> pa.RecordBatch:
        counts = [Counter(), Counter()]
        for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = set(_TOKEN.findall(fold(t)))
            counts[y].update({w[:n] for w in words for n in range(low, min(len(w), high) + 1)})
            counts[y][""] += 1
        keys = list(counts[0] | counts[1])
        return pa.record_batch([pa.array(keys, pa.string()), pa.array([counts[0][k] for k in keys], pa.int64()), pa.array([counts[1][k] for k in keys], pa.int64())], ["term", "clean", "toxic"])

    seen = by_blocks(src, prefixes, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rows = {r.term: (r.clean, r.toxic) for r in seen.where((F.col("term") == "") | (F.col("toxic") >= min_docs) & (F.col("toxic") > F.col("clean"))).collect()}
    n0, n1 = rows.pop("", (0, 0))
    base = math.log((n1 + 0.5) / (n0 + 0.5))
    odds = {t: math.log((b + 0.5) / (n1 + 1)) - math.log((a + 0.5) / (n0 + 1)) for t, (a, b) in rows.items()}
    terms = {t: w for t, w in odds.items() if w >= min_odds}
    # A beginning that nearly always goes on in one way stands for that longer one; of what remains the shortest stays.
    vague = {t[:-1] for t in terms if t[:-1] in terms and rows[t][1] >= 0.95 * rows[t[:-1]][1]}
    terms = {t: w for t, w in terms.items() if t not in vague}
    terms = {t: w for t, w in terms.items() if not any(t[:n] in terms and terms[t[:n]] >= w - 1.0 for n in range(low, len(t)))}
    if not n0 or not n1 or not terms:
        return Lexicon({}, set(), (base, 0.0, 0.0))
    lex = Lexicon(terms, set(), (base, 0.0, 0.0))

    def found(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            low = fold(t)
            per = Counter(lex.hits(low))
            rows.append((y, low.count(" ") + low.count("\n"), ["\t".join(k) for k in per], list(per.values())))
        y, n, k, v = zip(*rows, strict=True)
        return pa.record_batch([pa.array(y, pa.int32()), pa.array(n, pa.int64()), pa.array(k, pa.list_(pa.string())), pa.array(v, pa.list_(pa.int64()))], ["y", "n", "hits", "times"])

    sample = by_blocks(src, found, "y int, n long, hits array<string>, times array<long>").collect()  # sample_rows at most
    kept = _cover([{h.split("\t")[0] for h in r.hits} for r in sample if r.y], terms, min_gain)
    lex = Lexicon({t: terms[t] for t in kept}, set(), (base, 0.0, 0.0))
    per = [[(kept[t], c, a, b) for h, c in zip(r.hits, r.times, strict=True) for t, a, b in [h.split("\t")] if t in kept] for r in sample]
    phrases = [Counter(), Counter()]
    for r, hits in zip(sample, per, strict=True):
        phrases[r.y].update({p for h in hits for p in h[2:]})
    lex.exceptions = {p for p, n in phrases[0].items() if n >= 3 and not phrases[1][p]}
    x = []
    for r, hits in zip(sample, per, strict=True):
        weight = sum(c * w for w, c, a, b in hits if a not in lex.exceptions and b not in lex.exceptions)
        x.append((math.log1p(weight), math.log1p(1000 * weight / (r.n + 50))) if weight > 0 else (0.0, 0.0))
    lex.coef = _fit(np.array(x), np.array([r.y for r in sample], float))
    return lex


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score (0 to 1), predicted, n_hits for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by sample_rows and min_docs

    def block(b: pa.RecordBatch) -> pa.RecordBatch:
        lex = shared.value
        texts = b.column(2).to_pylist()
        scores = [lex.score(t) for t in texts]
        return pa.record_batch([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["id", "held_out", "score", "predicted"])

    src = docs.select(docs[id_col].alias("id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].alias("text"))
    return by_blocks(src, block, f"id {dict(src.dtypes)['id']}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
