"""Whole results of the line, quality and toxicity operators against plain restatements of their rules."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F
from test_brute_force import SF, kneser_ney

from tidewell.llm import line_dedup, quality_lm, toxicity

_FIELD = re.compile(r"(?<!\S)[^\s0-9]*[0-9]\S*", re.ASCII)
_BREAK = re.compile(r"\s+", re.ASCII)


def rank(token):
    """How equally frequent tokens are ordered: by their signed 64-bit hash."""
    x = xxhash.xxh64(token.encode(), seed=42).intdigest()
    return x - (1 << 64) if x >> 63 else x


def split_leaf(group, needed, dominance, similarity, found, name):
    """Lines of a group (tokens to how often they occur) that belong to a template, by the name of the group that gave it; the others by their most frequent token."""
    if len(group) < 2:
        return
    cells = defaultdict(lambda: [0, 0])
    for t, c in group.items():
        for at, token in enumerate(t):
            cells[at, token][0] += 1
            cells[at, token][1] += c
    width = len(next(iter(group)))
    fixed = {}
    for at in range(width):
        n, _, token = max((n, rank(token), token) for (a, token), (n, _) in cells.items() if a == at)
        if n >= dominance * len(group):
            fixed[at] = token
    onward = defaultdict(dict)
    for t, c in group.items():
        if len(fixed) >= similarity * width and all(t[at] == token for at, token in fixed.items()):
            found[t] = name
            continue
        usable = [(cells[at, x][0], -at, rank(x), x) for at, x in enumerate(t) if 1 < cells[at, x][0] < dominance * len(group) and cells[at, x][1] >= needed(width)]
        if usable:
            _, at, _, x = max(usable)
            onward[at, x][t] = c
    for by, part in onward.items():
        split_leaf(part, needed, dominance, similarity, found, (name, by))


def without_lines(rows, min_docs=10, short=10, depth=3, dominance=0.6, similarity=0.7):
    """(id, number of lines, dropped lines, text left) of each row (id, text)."""
    needed = lambda w: max(min(2, min_docs), math.ceil(min_docs * min(1.0, short / w)))
    lines, leaves = [], defaultdict(Counter)
    for i, text in rows:
        for no, line in enumerate((text or "").split("\n")):
            masked = _FIELD.sub("<*>", line.strip(" "))
            if masked:
                t = tuple(_BREAK.split(masked))
                lines.append((i, text or "", no, masked, t))
                if len(t) > depth:
                    leaves[len(t), t[:depth]][masked] += 1
    template = {}
    for leaf, group in leaves.items():
        if sum(group.values()) >= needed(leaf[0]) and len(group) > 1:
            # Lines that differ in white space only have the same tokens, but are lines of their own.
            found, names = {}, {}
            for masked, c in group.items():
                names[Line(_BREAK.split(masked), masked)] = c
            split_leaf(names, needed, dominance, similarity, found, leaf)
            template |= {t.masked: name for t, name in found.items()}
    texts, width = defaultdict(lambda: defaultdict(set)), {}
    for i, text, _, masked, t in lines:
        of = template.get(masked, masked)
        texts[of][text].add(i)
        width[of] = max(width.get(of, 0), len(t))
    recurring = {of for of, by in texts.items() if sum(map(len, by.values())) >= min_docs or len(by) >= needed(width[of])}
    gone = defaultdict(set)
    for i, text, no, masked, _ in lines:
        if template.get(masked, masked) in recurring:
            gone[i, text].add(no)
    out = []
    for i, text in rows:
        text = text or ""
        drop = gone[i, text]
        left = "\n".join(x for no, x in enumerate(text.split("\n")) if no not in drop) if drop else text
        out.append((i, text.count("\n") + 1 if text else 0, len(drop), left))
    return out


class Line(tuple):
    """A line's tokens; lines are equal where their masked texts are."""

    def __new__(cls, tokens, masked):
        made = super().__new__(cls, tokens)
        made.masked = masked
        return made

    def __eq__(self, other):
        return self.masked == other.masked

    def __hash__(self):
        return hash(self.masked)


def same(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in line_dedup.line_dedup(df, **options).collect())
    want = Counter(without_lines(rows, **options))
    assert got == want, (list((got - want).items())[:2], list((want - got).items())[:2])
    return sum(n for _, _, n, _ in want)


def test_lines_of_whole_documents_equal_a_plain_template_tree(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text").collect()]
    assert same(spark, rows) > 0


@pytest.mark.parametrize("seed", [1, 2])
def test_mixed_leaves_with_ties_equal_a_plain_template_tree(spark, seed):
    """Few tokens, so that leaves hold several templates, tokens tie and lines differ in white space only; repeated rows, null ids, null and very long texts."""
    rng = random.Random(seed)
    openings = [["sign", "in", "as"], ["page", "3", "of"], ["see", "all", "x9"]]
    line = lambda: rng.choice([" ", "  ", "\t"]).join([*rng.choice(openings), *(rng.choice("abcde" if rng.random() < 0.5 else "ab") for _ in range(rng.choice([2, 5, 5, 12])))])
    rows = [(i, "\n".join(line() if rng.random() < 0.8 else rng.choice(["", " ", "\t", f"only {i} here"]) for _ in range(rng.randint(0, 8)))) for i in range(150)]
    rows += [rows[3], rows[3], (None, rows[5][1]), (None, rows[5][1]), (500, None), (501, ""), (502, "\n".join(line() for _ in range(3000)))]
    assert same(spark, rows, min_docs=4, short=6) > 0


@pytest.mark.parametrize("order, hot", [(5, 16), (3, 1 << 18), (1, 4)])
def test_scores_agree_for_any_broadcast(spark, order, hot):
    """With few n-grams broadcast all others go through the joins; with many the lower orders need none."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9001, None), (9002, ""), (9003, "Ж中 \U0001f600 zq"), (9003, "Ж中 \U0001f600 zq")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality_lm.train(df.where("doc_id % 3 = 1").select("text"), order=order, hot=hot)
    assert model.hot.count() <= hot and (order == 1 or model.low.count() <= hot)
    bits = kneser_ney([t or "" for i, t in rows if i % 3 == 1], order)
    got = sorted((r.doc_id, r.lm_chars, r.lm_bits) for r in quality_lm.tallied(df, model).collect())
    want = sorted((i, len(t or ""), bits(t or "")) for i, t in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) <= 1e-4 * max(1.0, w[2]) for g, w in zip(got, want, strict=True))


def test_a_learned_lexicon_equals_plain_counts(spark):
    """Terms, exceptions and the fit, from every labelled row that isn't held out."""
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    lex = toxicity.learn(docs, labels)
    label = {}
    for r in labels.select("doc_id", F.col("toxic").cast("int").alias("y")).collect():
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 and r.y in (0, 1):
            label[r.doc_id] = max(r.y, label.get(r.doc_id, 0))
    rows = [(label[r.doc_id], toxicity.fold(r.text)) for r in docs.select("doc_id", "text").collect() if r.doc_id in label]
    n = Counter(y for y, _ in rows)
    words = [(y, [m.group() for m in re.finditer(r"[^\W\d_]+", t)]) for y, t in rows]
    count = Counter()
    for y, ws in words:
        count.update({(y, w[:k]) for w in ws for k in range(3, min(len(w), 10) + 1)})
    weight = {}
    for (y, t), b in count.items():
        a = count[0, t]
        if y and b >= 4 and b > a:
            w = math.log((b + 0.5) / (n[1] + 1)) - math.log((a + 0.5) / (n[0] + 1))
            if w >= 3.0:
                weight[t] = w
    vague = {t for t in weight if any(u[:-1] == t and count[1, u] >= 0.95 * count[1, t] for u in weight)}
    weight = {t: w for t, w in weight.items() if t not in vague}
    weight = {t: w for t, w in weight.items() if not any(t != u and t.startswith(u) and weight[u] >= w - 1.0 for u in weight)}
    hits = []  # of each text: term, phrase before, phrase after
    for y, ws in words:
        own = []
        for i, w in enumerate(ws):
            of = max((t for t in weight if w.startswith(t)), key=len, default=None)
            if of:
                own.append((of, (ws[i - 1] if i else "") + " " + w, w + " " + (ws[i + 1] if i + 1 < len(ws) else "")))
        hits.append(own)
    toxic = [{h[0] for h in own} for own, (y, _) in zip(hits, rows, strict=True) if y]
    holders = {t: {i for i, ts in enumerate(toxic) if t in ts} for t in set().union(*toxic)}
    kept, covered = set(), set()
    for t in sorted(holders, key=lambda t: (-len(holders[t]) * weight[t], t)):
        if len(holders[t] - covered) >= 3 or len(holders[t]) >= 0.1 * len(toxic):
            kept.add(t)
            covered |= holders[t]
    assert lex.terms.keys() == kept and all(abs(lex.terms[t] - weight[t]) < 1e-9 for t in kept)
    assert lex.terms, "nothing was learned"
    # The fit is where the slope of the penalised likelihood is nought.
    slope = [0.0, 0.0, 0.0]
    for y, t in rows:
        x = (1.0, *lex.features(t))
        z = sum(a * b for a, b in zip(lex.coef, x, strict=True))
        slope = [s + (y - 1 / (1 + math.exp(-z))) * v for s, v in zip(slope, x, strict=True)]
    for s, c, ridge in zip(slope, lex.coef, (1e-6, 1.0, 1.0), strict=True):
        assert abs(s - ridge * c) < 1e-3
    for phrase in lex.exceptions:  # only clean texts hold one, three at least
        having = [y for own, (y, _) in zip(hits, rows, strict=True) if any(h[0] in kept and phrase in h[1:] for h in own)]
        assert len(having) >= 3 and not any(having)
