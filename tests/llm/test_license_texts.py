"""Whole licence texts and notices with words inserted, changed and deleted anywhere, against brute force over all windows."""

import random
import re

import pytest

from tidewell.llm import license_scan
from tidewell.llm.license_texts import TEXTS

FILLER = "some plain words of no licence stand here and a reader goes on to other things with them".split()


def shingles(words, k):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(text):
    """Best containment of every template over its windows, 0.8 and more."""
    w, out = re.findall("[a-z0-9]+", text.lower()), {}
    for name, t in license_scan.TEMPLATES.items():
        t = re.findall("[a-z0-9]+", t.lower())
        k, stride = min(5, len(t)), len(t) // 2 + 1
        mine = shingles(t, k)
        best = max((len(mine & shingles(w[at : at + len(t) + stride - 1], k)) / len(mine) for at in range(0, max(1, len(w)), stride)), default=0)
        if best >= 0.8:
            out[name] = best
    return out


def altered(rng, text, n):
    words = text.split()
    for _ in range(n):
        at, how = rng.randrange(len(words)), rng.randrange(3)
        if how == 0:
            words.insert(at, rng.choice(FILLER))
        elif how == 1:
            words[at] = rng.choice(FILLER)
        else:
            del words[at]
    return " ".join(words)


@pytest.mark.parametrize("seed", [3, 4])
def test_recall_against_brute_force(spark, seed):
    rng, texts, of = random.Random(seed), [], []
    for name, t in license_scan.TEMPLATES.items():
        whole = name in TEXTS
        for n in range(12 if whole else 4):
            pad = [" ".join(rng.choices(FILLER, k=rng.randrange(400))) for _ in range(2)]
            texts.append(f"{pad[0]} {altered(rng, t, n if whole else n % 3)} {pad[1]}")
            of.append(name)
    got = {r.doc_id: {m.license: m.containment for m in r.matches} for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    held = found = 0
    for i, t in enumerate(texts):
        want = brute(t)
        assert all(c <= want.get(m, 0) + 1e-9 for m, c in got[i].items()), of[i]  # nothing that brute force doesn't find
        if of[i] in want:
            held += 1
            found += got[i].get(of[i], 0) == pytest.approx(want[of[i]])
    assert held >= 60 and found >= 0.99 * held


def test_a_whole_text_is_known_by_its_name(spark):
    texts = [t.upper() for t in TEXTS.values()]
    got = {r.doc_id: {m.license for m in r.matches} for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, name in enumerate(TEXTS):
        assert name in got[i] and got[i] & set(TEXTS) == {name}
