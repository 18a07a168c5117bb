"""Figures of the llm operators against plain restatements, and rows with nulls, repeats, ties and clashing names."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewell.llm import common, decontaminate, exact_dedup, jaccard_join, license_scan, line_dedup, pii, quality_lm, sentencepiece_lattice, token_counts, toxicity

SF = "/root/testdata/sf0.001"
#: Names that the operators use for themselves.
CLASH = "id long, lang string, key string, lm_lang string, gone string, kept string, n long, row string, `_key` string, `_row` string, spans string, component_id long"


def kneser_ney(texts, order=5):
    """Bits of a text under an interpolated modified Kneser-Ney model, with the empty context at the bottom."""
    pad = "\x03" * (order - 1)
    counts = [None] * (order + 1)
    counts[order] = Counter()
    for t in texts:
        t = pad + t
        counts[order].update(t[i - order + 1 : i + 1] for i in range(order - 1, len(t)))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cuts, sums = [None] * (order + 1), [None] * (order + 1)
    for n in range(1, order + 1):
        of = Counter(counts[n].values())
        n1, n2, n3, n4 = (of[i] for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        cuts[n] = [0.0] + [max(0.05, min(i - 0.05, i - (i + 1) * y * b / a)) if a and b else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        sums[n] = defaultdict(lambda: [0, 0.0])
        for g, c in counts[n].items():
            cell = sums[n][g[:-1]]
            cell[0] += c
            cell[1] += cuts[n][min(c, 3)]
    chars = len(counts[1]) + 1
    known = {}

    def p(g):
        if not g:
            return 1 / chars
        if g not in known:
            n = len(g)
            total, mass = sums[n].get(g[:-1], (0, 0.0))
            c = counts[n].get(g, 0)
            known[g] = ((c - cuts[n][min(c, 3)]) / total + mass / total * p(g[1:])) if total else p(g[1:])
        return known[g]

    def bits(t):
        t = pad + t
        return sum(-math.log2(max(p(t[i - order + 1 : i + 1]), 1e-12)) for i in range(order - 1, len(t)))

    return bits


def judge(rows, good, folds=2, prior=200.0, quantile=0.998, least=20):
    """Whether each row (id, lang, text) is accepted."""
    fold = lambda i: 0 if i is None else zlib.crc32(str(i).encode()) % folds
    models = [kneser_ney([t or "" for i, _, t in rows if i in good and fold(i) != f]) for f in range(folds)]
    bits = [models[fold(i)](t or "") for i, _, t in rows]
    held = [j for j, r in enumerate(rows) if r[0] in good]
    mean = sum(bits[j] for j in held) / sum(len(rows[j][2] or "") for j in held)
    ppl = [2 ** ((b + prior * mean) / (len(r[2] or "") + prior)) for b, r in zip(bits, rows, strict=True)]
    at = lambda x: sorted(x)[math.ceil(quantile * len(x)) - 1]
    limits = {}
    for lang in {rows[j][1] for j in held}:
        own = [ppl[j] for j in held if rows[j][1] == lang]
        if len(own) >= least:
            limits[lang] = at(own)
    overall = at([ppl[j] for j in held])
    return ppl, [x <= limits.get(r[1], overall) for x, r in zip(ppl, rows, strict=True)]


def low(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """The smallest documents, with nulls, repeated ids, equal rows, near and exact copies, passages of the benchmark and columns of clashing names."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    long = [r for r in rows if r[1] and 60 <= len(r[1].split()) <= 300]
    a, b, c, d = long[3], long[7], long[11], long[15]
    more = [(a[0], b[1] + " and so on", b[2]), (5001, a[1].upper(), a[2]), (5002, a[1], a[2]), (5002, a[1], a[2]), (5003, c[1] + " more", c[2]), (5004, d[1] + "\n" + bench[0], d[2]), (None, None, None), (5005, "", "en"), (5006, None, "xx"), (None, c[1].replace("a", "A"), c[2])]
    rows += more
    p = str(tmp_path_factory.mktemp("sf"))
    names = [x.split()[0].strip("`") for x in CLASH.split(", ")]
    df = spark.createDataFrame([(*r, *([None] * len(names))) for r in [(i, t, g) for i, t, g in rows]], "doc_id long, text string, lng string, " + CLASH.replace("lang string", "lang_ string")).drop("lang_").withColumnRenamed("lng", "lang")
    df.write.parquet(f"{p}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{p}/{t}.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    return p, rows, good, bench


def test_perplexities_equal_kneser_ney(spark, corpus):
    p, rows, good, _ = corpus
    out = quality_lm.classify(common.documents(spark, p), common.table(spark, p, "labels")).collect()
    ppl, accepted = judge([(i, g, t) for i, t, g in rows], good)
    want = sorted((str(r[0]), round(x, 2), y) for r, x, y in zip(rows, ppl, accepted, strict=True))
    got = sorted((str(r.doc_id), round(r.perplexity, 2), r.accepted) for r in out)
    assert [(i, y) for i, _, y in got] == [(i, y) for i, _, y in want]
    assert all(abs(g[1] - w[1]) < 0.02 for g, w in zip(got, want, strict=True))


def test_pipeline_equals_a_plain_restatement(spark, corpus):
    import sentencepiece

    import corpus_pipeline

    p, rows, good, bench = corpus
    _, ok = judge([(i, g, t) for i, t, g in rows], good)
    left = [(i, t) for (i, t, _), y in zip(rows, ok, strict=True) if y]
    best = {}
    for i, t in left:
        best[low(t)] = max(best.get(low(t), (-1, 0, "")), (-1 if i is None else i, 0, ""))
    once = {}
    for i, t in left:
        if (-1 if i is None else i) == best[low(t)][0]:
            once.setdefault((i, low(t)), []).append(t)
    left = [(i, min(ts, key=lambda t: (t is not None, t or ""))) for (i, _), ts in once.items()]
    sets = []
    for _, t in left:
        w = re.findall(rb"[^\x20\x09-\x0D]+", low(t).encode())
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(left)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first = lambda j: (left[j][0] is not None, left[j][0] or 0)
    for x in range(len(left)):
        for y in range(x):
            if sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)), key=first)
                root[b] = a
    left = [r for j, r in enumerate(left) if find(j) == j]
    wins = set()
    for t in bench:
        w = decontaminate.words(t)
        n = min(10, len(w))
        wins |= {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in wins}

    def hit(t):
        w = decontaminate.words(t)
        return any(tuple(w[j : j + n]) in wins for n in sizes for j in range(len(w) - n + 1))

    left = [(i, t) for i, t in left if not hit(t)]
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL)
    got = corpus_pipeline.run(spark, p).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids) for r in got) == sorted((str(i), len(e), e) for i, t in left for e in [sp.encode(t or "")])
    assert all(r.round_trip for r in got) and 100 < len(got) < len(rows)


def test_stages_keep_columns_and_stand_empty_tables(spark, corpus):
    import corpus_pipeline

    p = corpus[0]
    d = common.documents(spark, p)
    empty = spark.createDataFrame([], d.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, p)
        assert out.columns == d.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, p).count() == 0


def test_every_operator_stands_repeats_nulls_and_empty_tables(spark, corpus):
    p, rows, _, _ = corpus
    d, labels, bench = common.documents(spark, p), common.table(spark, p, "labels"), common.table(spark, p, "benchmark")
    lex = toxicity.learn(d, labels)
    pieces = sentencepiece_lattice.load()
    runs = [
        lambda x: pii.pii_spans(x), lambda x: exact_dedup.exact_dedup(x), lambda x: token_counts.token_counts(x), lambda x: sentencepiece_lattice.encode(x, pieces), lambda x: line_dedup.line_dedup(x),
        lambda x: license_scan.license_scan(x), lambda x: decontaminate.contamination(x, bench), lambda x: jaccard_join.similar_components(x), lambda x: toxicity.score_toxicity(x, lex), lambda x: decontaminate.contamination(x, bench.limit(0)),
    ]
    for i, run in enumerate(runs):
        assert run(d).count() == len(rows), i
        assert run(d.limit(0)).count() == 0, i


def test_line_ties_at_the_bounds(spark):
    def run(texts, **options):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return [r.n_dropped for r in line_dedup.line_dedup(df, **options).orderBy("doc_id").collect()]

    own = [" ".join(chr(97 + i) * 2 + chr(97 + j) for j in range(4)) for i in range(10)]
    assert run([f"{o}\nthe same line" for o in own[:5]], min_docs=5) == [1] * 5
    assert run([f"{o}\nthe same line" for o in own[:4]], min_docs=5) == [0] * 4
    # Three of five lines share the tokens of a template: exactly the share that is enough.
    lines = [f"go on and {x} here now" for x in ("one", "two", "six")] + ["go on and a b c", "go on and d e f"]
    assert run(lines, min_docs=3, short=100, dominance=0.6, similarity=0.5)[:3] == [1, 1, 1]


def test_altered_notices_are_found(spark):
    rng = random.Random(9)
    filler = [f"w{i}" for i in range(500)]
    texts, names = [], []
    for name, notice in license_scan.TEMPLATES.items():
        words = re.findall("[a-z0-9]+", notice.lower())
        for n in range(40):
            changed = list(words)
            if len(words) >= 20 and n % 2:  # one word at an end: at most one shingle in sixteen goes
                changed[-1 if n % 4 == 1 else 0] = "changed"
            around = [rng.choice(filler) for _ in range(rng.randint(0, 80))]
            at = rng.randint(0, len(around))
            texts.append(" ".join(around[:at] + changed + around[at:]))
            names.append(name)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {m.license for m in r.matches} for r in license_scan.license_scan(df).collect()}
    assert sum(name in got[i] for i, name in enumerate(names)) >= 0.99 * len(names)


def test_toxicity_scores_equal_a_plain_lexicon():
    lex = toxicity.Lexicon({"zork": 4.0, "zorkan": 6.0, "bl": 3.5}, {"zorkan soup"}, (-3.0, 1.0, 0.5))

    def plain(text):
        t = toxicity.fold(text)
        words = [(m.group(), m.start()) for m in re.finditer(r"[^\W\d_]+", t)]
        weight = 0.0
        for i, (w, _) in enumerate(words):
            term = max((x for x in lex.terms if w.startswith(x)), key=len, default=None)
            if term is None:
                continue
            before, after = words[i - 1][0] if i else "", words[i + 1][0] if i + 1 < len(words) else ""
            if f"{before} {w}" not in lex.exceptions and f"{w} {after}" not in lex.exceptions:
                weight += lex.terms[term]
        if weight <= 0:
            return 1 / (1 + math.exp(3.0))
        n = t.count(" ") + t.count("\n") + 50
        return 1 / (1 + math.exp(-(-3.0 + math.log1p(weight) + 0.5 * math.log1p(1000 * weight / n))))

    rng, parts = random.Random(10), ["zork", "zorkan", "Z0RKAN", "soup", "black", "azork", "fine", "x", "zorkanist", ",", "\n", "ƶork"]
    for _ in range(500):
        t = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert abs(lex.score(t) - plain(t)) < 1e-12, t
    assert lex.score("zorkan soup") == lex.score(None) < lex.score("zorkan stew")


def test_key_index_finds_what_a_dict_finds():
    import numpy as np

    from tidewell.llm.quality_lm import _Index

    made = np.random.default_rng(3)
    for size in (0, 1, 2, 5000):
        keys = made.integers(-(2**63), 2**63 - 1, size)
        keys[size // 2 :] = np.where(made.random(size - size // 2) < 0.1, keys[: size - size // 2], keys[size // 2 :])  # repeated keys
        asked = np.concatenate([keys, made.integers(-(2**63), 2**63 - 1, 500), np.arange(-5, 5)])
        found, held = _Index(keys).find(asked), set(keys.tolist())
        assert [f >= 0 for f in found] == [a in held for a in asked.tolist()]
        assert (keys[found[found >= 0]] == asked[found >= 0]).all()
