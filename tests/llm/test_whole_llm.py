"""The llm operators do the whole job where lines, notices and chunks meet."""

import random

from tidewell.llm import license_scan, line_dedup, sentencepiece_lattice

SCHEMA = "doc_id long, text string"


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA)


def name(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(3))


def test_mixed_leaves_keep_all_their_templates(spark):
    rng = random.Random(7)
    one = [f"please sign in as {name(i)} to read the whole story here" for i in range(60)]
    two = [f"please sign in with {name(i)} at once or buy it {name(i * 7)}" for i in range(60)]
    three = [f"please sign in under {name(i % 5)} and see {name(i)} other things there" for i in range(30)]
    other = ["please sign in " + " ".join(name(rng.randrange(17_000)) for _ in range(8)) for _ in range(45)]
    texts = one + two + three + other
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs(spark, texts)).collect()}
    assert [i for i in range(150) if got[i].text] == []
    assert [got[i].text for i in range(150, len(texts))] == other


def test_long_lines_need_fewer_texts(spark):
    rng = random.Random(8)
    line = lambda n: " ".join(name(rng.randrange(17_000)) for _ in range(n))
    long, middle, short, copied = line(60), line(25), line(8), line(70)
    texts = [f"{line(4)}\n{long}\n{short}" for _ in range(2)] + [f"{line(4)}\n{middle}\n{short}" for _ in range(4)] + [f"{line(4)}\n{line(25)}" for _ in range(3)] + [copied, copied]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs(spark, texts)).collect()}
    assert all(got[i] == "\n".join(x for x in texts[i].split("\n") if x not in (long, middle)) for i in range(len(texts)))
    assert got[0] != texts[0] and got[2] != texts[2] and got[9] == copied


def test_a_license_only_yields_at_its_own_words(spark):
    bsd = license_scan.TEMPLATES["bsd-3-clause"].rsplit(" ", 2)[0] + " were kept"
    gpl2, gpl3 = license_scan.TEMPLATES["gpl-2.0"], license_scan.TEMPLATES["gpl-3.0"]
    filler = "some plain words of no licence stand here " * 20
    near = gpl2.replace("version 2", "version 2x")
    texts = ["All rights reserved. " + bsd, bsd + " All rights reserved.", gpl3, gpl3 + " " + near, f"{gpl3} {filler} {near}", f"{gpl3} {gpl2}", f"All rights reserved. {bsd} {filler} {bsd}"]
    got = {r.doc_id: {m.license: m.containment for m in r.matches} for r in license_scan.license_scan(docs(spark, texts)).collect()}
    assert got[0].keys() == got[1].keys() == got[6].keys() == {"all-rights-reserved", "bsd-3-clause"} and 0.8 <= got[0]["bsd-3-clause"] < 1
    assert got[2] == {"gpl-3.0": 1.0} and got[5] == {"gpl-2.0": 1.0, "gpl-3.0": 1.0}
    assert got[3].keys() == got[4].keys() == {"gpl-2.0", "gpl-3.0"} and got[3]["gpl-2.0"] == got[4]["gpl-2.0"] == 0.875


def test_chunks_of_every_length_at_the_end_of_the_lattice(spark):
    import sentencepiece

    sp, pieces = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL), sentencepiece_lattice.load()
    texts = [c * n for n in range(59, 66) for c in ("-", "a", " ", "=", "ab")]
    sizes = {n for t in texts for n in sentencepiece_lattice.chunks([t], pieces)[2].tolist()}
    assert {60, 61, 62, 63, 64} <= sizes
    got = sentencepiece_lattice.encode(docs(spark, texts), pieces).collect()
    assert len(got) == len(texts) and all(r.ids == sp.encode(texts[r.doc_id]) and r.round_trip for r in got)


def test_cutting_a_block_into_chunks_takes_little_memory():
    import tracemalloc

    from tidewell.llm import sentencepiece_lattice as lattice

    pieces, words = lattice.load(), [f"word{i % 977} {i % 31}" for i in range(lattice.CHUNK_BYTES // 10)]
    tracemalloc.start()
    lattice.chunks([" ".join(words)], pieces)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20, peak
