"""The llm operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewell.llm import common, decontaminate, exact_dedup, jaccard_join, license_scan, line_dedup, pii, quality_lm, sentencepiece_lattice, token_counts, toxicity
from tidewell.llm.components import components

SCHEMA = "doc_id long, text string, lang string, n long, id string, set long, keep_id long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", 7, "x", 1, 2) for i, t in enumerate(texts)], SCHEMA)


ODD = [None, "", " ", "A", "a", "é", "x" * 20_000, "word " * 9_000, "\n\n", "Ab Cd", "aB cD", "日本 語"]


def test_pii_base_spans_match_the_plain_patterns():
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def keeps(kind, s):
        digits = re.sub(r"\D", "", s)
        return kind == "email" or kind == "ip" and all(int(p) <= 255 for p in s.split(".")) or kind == "card" and 12 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15

    rng, parts = random.Random(1), ["a@b.c", "_d@e.f", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", "+1 (017) 555-7713", "..", "@", "+", " ", "é", "a%", "-", "12", "x@y", "4111-1111-1111-1112", "1.2.3.4.5.6.7.8", "+49 30 1234567 "]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        want = sorted((m.start(), m.end(), k) for k, p in plain.items() for m in re.finditer(p, t) if keeps(k, m.group()))
        assert sorted((s, e, k) for k, s, e, _ in pii.find(t) if k in pii.BASE) == want, t


def test_pii_extras_and_odd_texts(spark):
    t = "IBAN GB82 WEST 1234 5698 7654 32 and GB00 WEST 1234 5698 7654 32; ssn 123-45-6789, plain 123-45-6789"
    assert [k for k, *_ in pii.find(t)].count("iban") == 1
    assert pii.find("ssn 123-45-6789")[0][0] == "ssn" and not pii.find("number 123-45-6789")
    assert [k for k, *_ in pii.find('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x')] == ["secret"]
    assert not pii.find("token abcdefghijklmnopqrstuvwxyz " + "x9" * 200) and not pii.find("some 04dbebab91ab85687d33eeaaf9ac699e1188f962 here") and not pii.find("9" * 30_000 + " token " + "a" * 30_000)
    assert pii.pii_spans(docs(spark, ODD)).count() == len(ODD)
    assert pii.pii_spans(docs(spark, [])).count() == 0


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    texts = [*ODD, None, "A", "é", "É", "same", "SAME", "same"]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, texts), digest=F.length("norm") % 3 if weak else None, broadcast_bytes=0 if weak else 1 << 20).collect()}
    norm = [re.sub("[A-Z]", lambda m: m.group().lower(), t or "") for t in texts]
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(same), len(same), i == max(same), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_ascii_lower_on_every_letter(spark):
    chars = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c + "Q",) for c in chars], "text string")
    assert [r.y for r in df.select(common.ascii_lower(F.col("text")).alias("y")).collect()] == [(c.lower() if c.isascii() else c) + "q" for c in chars]


@pytest.mark.parametrize("rule", ["majority", "start", "fraction"])
def test_token_counts(spark, rule):
    texts = [*ODD, "One. Two three! Four\nfive.  Six", "ab. é日本。 x"]
    enc, _ = token_counts.encoder(token_counts.VOCABULARY, token_counts.PATTERN)
    for r in token_counts.token_counts(docs(spark, texts), rule=rule).collect():
        t = texts[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert r.n_tokens == len(ids) and abs(sum(s.tokens for s in r.sections) - len(ids)) < 1e-6
        assert "".join(t[s.start : s.end] for s in r.sections) == t
        ends, want = [], [0.0] * len(r.sections)
        for i in ids:
            ends.append((ends[-1] if ends else 0) + len(enc.decode_single_token_bytes(i)))
        bounds = [(len(t[: s.start].encode()), len(t[: s.end].encode())) for s in r.sections]
        for s, e in zip([0, *ends], ends, strict=False):
            over = [max(0, min(e, b) - max(s, a)) for a, b in bounds]
            if rule == "fraction":
                want = [w + o / (e - s) for w, o in zip(want, over, strict=True)]
            else:
                want[over.index(max(over)) if rule == "majority" else next(i for i, o in enumerate(over) if o)] += 1
        assert all(abs(w - s.tokens) < 1e-6 for w, s in zip(want, r.sections, strict=True))


def test_quality_model_sums_to_one_and_separates(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["the", "cat", "sat", "on", "mat", "dog"]) for _ in range(60)) for _ in range(150)]
    bad = ["".join(rng.choice("#%&$|!") for _ in range(300)) for _ in range(10)]
    d = docs(spark, good + bad + ODD[:3])
    labels = spark.createDataFrame([(i, 1) for i in range(150)] + [(150, 0), (None, 1)], "doc_id long, quality int")
    model = quality_lm.train(d.where("doc_id < 150"))
    rows = model.rows.orderBy("key").toArrow()
    known, values = rows.column("key").to_numpy(), rows.column("value").to_numpy()
    seen = sorted(set("".join(good)))
    assert model.chars == len(seen) + 1
    for context in ("", "the ", "cat sat", "zzzz", "\u65e5"):
        total = [2.0 ** -(lambda b: b[1] - b[0])(quality_lm._bits([context, context + c], model.order, model.floor, known, values)[0]) for c in [*seen, "\u8a9e"]]
        assert abs(sum(total) - 1) < 1e-5, context
    one, two = ({r.doc_id: r.perplexity for r in quality_lm.classify(d, labels, broadcast_bytes=n).collect()} for n in (1 << 27, 0))
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-9 for i in one)
    got = {r.doc_id: r.accepted for r in quality_lm.classify(d, labels).collect()}
    assert all(got[i] for i in range(150)) and not any(got[i] for i in range(150, 160)) and got[160] and got[161]
    assert all(r.accepted for r in quality_lm.classify(d, labels.where("quality > 1")).collect())


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    sp, pieces = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL), sentencepiece_lattice.load()
    texts = [*ODD, "  a  b ", "a\tb\x00c", "ﬁ Ａ 𝄞", " " * 80 + "x", "a" * 200, "int main() { return 0; } // don't", "https://example.com/a?b=c"]
    for bound in (1 << 28, 0):
        got = sentencepiece_lattice.encode(docs(spark, texts), pieces, broadcast_bytes=bound).collect()
        assert len(got) == len(texts)
        for r in got:
            assert r.ids == sp.encode(texts[r.doc_id] or "") and r.round_trip
    back = sentencepiece_lattice.decode(sentencepiece_lattice.encode(docs(spark, texts), pieces), pieces).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(texts)}


def test_line_dedup(spark):
    texts = [f"own {chr(97 + i) * 3} line\nCookie notice for user {i} of this site\n\nthe end" for i in range(6)] + ODD
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs(spark, texts), min_docs=5).collect()}
    for i in range(6):
        assert (got[i].text, got[i].n_dropped, got[i].n_lines) == (f"own {chr(97 + i) * 3} line\n", 2, 4)
    assert [got[6 + i].text for i in range(len(ODD))] == [t or "" for t in ODD]


def test_line_templates_generalise(spark):
    texts = [f"Posted by {n} on the old forum page" for n in ("ann", "bob", "cid", "dan", "eve")]
    got = line_dedup.line_dedup(docs(spark, texts), min_docs=5, depth=2).collect()
    assert all(r.n_dropped == 1 and r.text == "" for r in got)


def test_license_scan(spark):
    texts = [*ODD, "Some words. Released under the MIT License. More.", "This work is licensed under the GNU General Public License, version 3.", "x All rights reserved.", "licensed under the open road"]
    got = {r.doc_id: [(m.license, m.containment) for m in r.matches] for r in license_scan.license_scan(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    n = len(ODD)
    assert got[n] == [("mit", 1.0)] and got[n + 1] == [("gpl-3.0", 1.0)] and got[n + 2] == [("all-rights-reserved", 1.0)] and got[n + 3] == [] and not any(got[i] for i in range(n))


def test_contamination(spark):
    rng, vocab = random.Random(3), ["a", "b", "c", "D", "é", "7"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 2, 4, 5, 9])))) for i in range(12)] + [(12, None), (None, "a b c")]
    texts = [*ODD, *(", ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bound in (1 << 20, 20):
        got = {r.doc_id: r for r in decontaminate.contamination(docs(spark, texts), bench, window=4, max_bench_bytes=bound).collect()}
        for i, t in enumerate(texts):
            w, hit, seen = decontaminate.words(t), set(), set()
            for item, u in items:
                v = decontaminate.words(u)
                n = min(4, len(v))
                wins = {tuple(v[p : p + n]) for p in range(len(v) - n + 1)} if n else set()
                for p in range(len(w) - n + 1) if n else ():
                    if tuple(w[p : p + n]) in wins:
                        hit.update(range(p, p + n))
                        seen |= {str(item)} if item is not None else set()
            assert (got[i].n_words, got[i].n_hit, got[i].items, got[i].contaminated) == (len(w), len(hit), sorted(seen), bool(hit))


@pytest.mark.parametrize("cap,bound", [(16, 1 << 20), (2, 0)])
def test_jaccard_components(spark, cap, bound):
    rng, vocab = random.Random(4), [f"w{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(120)]
    texts = [*ODD, "a b c", "A B c"]
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w[: rng.choice([120, 110, 100])]))
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randint(4, 40))) for _ in range(40)] + [" ".join(base[:60] + [rng.choice(vocab) for _ in range(20)]) for _ in range(12)]
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(docs(spark, texts), cap=cap, block=8, broadcast_bytes=bound).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_groups_stream_any_cut():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = sorted({(int(s), int(x)) for s, x in zip(rng.integers(0, 12, 200), rng.integers(0, 40, 200), strict=True)} | {(5, x) for x in range(60)})
    for cut in (1, 3, 7, 1000):
        batches = [pa.record_batch([pa.array([s for s, _ in rows[i : i + cut]]), pa.array([x for _, x in rows[i : i + cut]])], ["sig", "set"]) for i in range(0, len(rows), cut)]
        got = [r for b in jaccard_join._groups(iter(batches), 4) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        want = []
        for s in sorted({s for s, _ in rows}):
            xs = [x for t, x in rows if t == s]
            want += [(s, x, xs[0], len(xs) > 4) for x in xs if len(xs) > 1]
        assert got == want, cut


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (3, 1), (9, 9), (7, 8), (8, 3)], "a long, b long")
    assert {r.node: r.comp for r in components(links).collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 4: 4, 5: 4}


def test_toxicity(spark):
    rng = random.Random(6)
    clean = [" ".join(rng.choice(["apple", "river", "stone", "cloud"]) for _ in range(rng.randint(5, 60))) for _ in range(200)]
    toxic = [c + " " + rng.choice(["zorkig", "zorkan", "1diot", "id10t"]) for c in clean[:60]]
    d = docs(spark, clean[60:] + toxic + ODD)
    labels = spark.createDataFrame([(i, int(i >= 140)) for i in range(200)] + [(None, 1)], "doc_id long, toxic int")
    lex = toxicity.learn(d, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, lex).collect()}
    assert len(got) == 200 + len(ODD) and all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[i].predicted == int(i >= 140) for i in range(200)) >= 196
    assert toxicity.fold("ІD10Т аpple 2024") == "idiot apple 2024"
    assert toxicity.score_toxicity(d, toxicity.learn(d, labels.where("toxic > 1"))).count() == 200 + len(ODD)


def test_pipeline_stages(spark):
    import corpus_pipeline

    d, columns = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.staged(stage(spark, d, "/root/testdata/sf0.001"), "test-stage")
        assert out.columns == d.columns and 0 < out.count() <= d.count(), name
        if name == "exact dedup":
            low = [re.sub("[A-Z]", lambda m: m.group().lower(), r.text or "") for r in out.collect()]
            assert len(low) == len(set(low))
        d = out
    assert columns is None and d.count() > 100
