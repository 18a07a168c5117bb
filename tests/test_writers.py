"""The trained language detector, observed assertions and the JSON array writer."""

import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import curate, language
from tidewell.plans import registry
from tidewell.sources import datasets


def test_language_of_held_out_rows(spark):
    rows = [r for r in registry.QUERIES["m11_language"](spark, "/root/testdata/sf0.01").collect() if r.held_out and r.language]
    right = sum(r.language == r.lang.upper() for r in rows)
    assert len(rows) > 150 and right / len(rows) >= 0.98, (right, len(rows))


def test_detector_equals_a_plain_naive_bayes(spark):
    r = random.Random(4)
    words = {"en": ["the", "house", "with", "Three"], "de": ["das", "Häuser", "mit", "drei"], "fr": ["la", "maison", "avec", "trois"]}
    rows = [(i, lang, " ".join(r.choices(words[lang], k=12))) for i, lang in enumerate(r.choices(["en", "en", "de", "fr"], k=90))] + [(200, None, "x"), (201, "en", None), (202, "en", "")]
    d = language.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3))
    assert d.names == ["DE", "EN", "FR"]
    size, asked = d.weights.shape[1], ["mit the Maison", "Häuser", "trois maisons!", "12 %", "", "ß"]

    def hashed(text):
        out, mask = [], 2**64 - 1
        kept = "".join(c if c.isalpha() else " " for c in text.lower())
        kept = " " + " ".join(kept.split()) + " "
        for n in range(1, 5):
            for i in range(len(kept) - n + 1):
                code = 0
                for k in range(n):
                    code = (code * 0x100000001B3 + ord(kept[i + k]) + k + 1) & mask
                out.append((((code ^ (code >> 29)) * 0xBF58476D1CE4E5B9 & mask) >> 40) % size)
        return out

    counts = {n: [0.5] * size for n in d.names}
    for _, lang, text in rows:
        if lang and text:
            for b in hashed(text):
                counts[lang.upper()][b] += 1
    totals = {n: sum(c) for n, c in counts.items()}
    share = {n: math.log(sum(x[1] == n.lower() and x[2] is not None for x in rows) / 91) for n in d.names}
    for text in asked:
        if any(c.isalpha() for c in text):
            want = [share[n] + sum(math.log(counts[n][b] / totals[n]) for b in hashed(text)) for n in d.names]
            assert np.allclose(d.scores(text), want)
    got = spark.createDataFrame([(t,) for t in [*asked, None]], "t string").select(language.detected(spark, d, F.col("t")).alias("x")).collect()
    assert [x.x for x in got][1:5] == ["DE", "FR", None, None] and got[-1].x is None
    assert language.learn(spark.createDataFrame([], "doc_id long, lang string, text string")).detect(["a"]) == [None]


def _rows(spark, pairs):
    return spark.createDataFrame([(i, (a,), (b,)) for i, (a, b) in enumerate(pairs)], "conversation_id long, gen_input_configs struct<input_generator:string>, gen_response_configs struct<output_generator:string>")


def test_violations_are_counted_while_the_job_runs(spark, tmp_path):
    path = str(tmp_path / "out")
    good = _rows(spark, [("m", "m"), ("org/m", "org/m")])
    assert curate.write_checked(good, "m", path) == {"rows": 2, "missing": 0, "missing_first": None, "differ": 0, "differ_first": None, "foreign": 0, "foreign_first": None}
    assert spark.read.parquet(path).count() == 2
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    bad = _rows(spark, [("m", "m"), ("x", "x"), (None, "m"), ("m", "n"), ("m", None), ("y", "y")])
    with pytest.raises(ValueError, match=r"6 rows: 2 missing \(first: 2\), 1 differ \(first: 3\), 2 foreign \(first: 1\)"):
        curate.write_checked(bad.mapInArrow(counted, bad.schema), "m", path)
    assert reads.value == 6 and not os.path.exists(path)


def test_json_array_equals_an_indented_dump(spark, tmp_path):
    path = str(tmp_path / "x.json")
    rows = [(i, None if i % 7 == 0 else f'line\n"{i}" é 日', [i, i + 1] if i % 2 else [], {"a": None, "b": f"x{i}"}) for i in range(250)]
    df = spark.createDataFrame(rows, "id long, text string, list array<long>, cell struct<a:string,b:string>").repartitionByRange(5, "id").sortWithinPartitions("id")
    want = json.dumps([{"id": i, "text": t, "list": x, "cell": c} for i, t, x, c in rows], indent=2, ensure_ascii=False)
    for _ in range(2):
        datasets.write_json_array(df, path)
        assert open(path, encoding="utf-8").read() == want
    datasets.write_json_array(df.limit(0), path)
    assert open(path).read() == "[]"
    with pytest.raises(ValueError, match="more than 10"):
        datasets.write_json_array(df, path, 10)


def test_an_aborted_array_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "x.json")
    df = spark.range(100).repartition(4).select(F.when(F.col("id") == 57, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        datasets.write_json_array(df, path)
    assert os.listdir(tmp_path) == []


def test_json_array_is_read_back_in_splits_whatever_its_strings_hold(spark, tmp_path):
    odd = ['\n  }', '",\n  {\n', "]", "[\n  {", "é \U0001f600", "\\", '"', "", None, "}\n]"]
    rows = [(i, odd[i % len(odd)], [{"k": odd[(i + 3) % len(odd)]}, None] if i % 3 else None, {"a": i} if i % 2 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, s string, l array<struct<k:string>>, m map<string,long>")
    path = str(tmp_path / "a.json")
    datasets.write_json_array(df.repartition(3), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = datasets.read_dataset(spark, path, df.schema)
        assert got.rdd.getNumPartitions() > 8
        assert got.schema == df.schema
        assert sorted(got.collect()) == sorted(df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("body", ['[{"id": 1}, {"id": 2}]', '[\n  {\n    "id": 1\n  }, {"id": 2}, {\n "id": 3\n  }\n]', '[\n    {\n        "id": 1\n    },\n    {\n        "id": 2, "x": {\n        }\n    }\n]\n', "[\r\n  {\r\n  }\r\n]", "[]", "[\n]", '[\n  {"id": 4},\n  {\n    "id": 5\n  }\n]', '[\n\t{\n\t\t"id": 6\n\t},\n\t{\n\t\t"id": null\n\t}\n]'])
def test_json_arrays_of_any_layout_equal_the_parser(spark, tmp_path, body):
    path = str(tmp_path / "a.json")
    with open(path, "w", newline="") as f:
        f.write(body)
    key = lambda x: (x is None, x)
    assert sorted((r.id for r in datasets.read_dataset(spark, path, "id long").collect()), key=key) == sorted((r.get("id") for r in json.loads(body)), key=key)


@pytest.mark.parametrize("body", ['[\n  {\n    "id": 1\n  },\n', '[\n  {\n    "id": 1\n  }', '[\n  {\n    "id": 1\n  },\n  {\n    "id": \n  }\n]', '[\n  {\n    "id": 1\n  }\n  {\n    "id": 2\n'])
def test_broken_json_arrays_fail(spark, tmp_path, body):
    path = str(tmp_path / "a.json")
    with open(path, "w") as f:
        f.write(body)
    with pytest.raises(Exception, match="(?i)malformed|corrupt|parse"):
        datasets.read_dataset(spark, path, "id long").collect()


@pytest.mark.parametrize("n", [0, 1, 37, 60, 199, 200, 500])
def test_the_sample_is_the_first_by_hash_and_no_sort_gathers_texts(spark, n):
    rows = spark.createDataFrame([("DE" if i % 3 else "EN", f"text {i}", i // 4) for i in range(200)], "lang string, text string, i long").select("lang", "text", F.xxhash64("i").alias("h"))
    got = language._first(rows.repartition(5), n)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan
    keys = sorted((r.h, r.lang) for r in rows.collect())[:n]
    assert sorted((r.h, r.lang) for r in got.collect()) == keys


def test_the_detector_learns_from_every_row(spark):
    n = 24_000
    rows = spark.range(n).selectExpr("id as doc_id", "if(id % 3 = 0, 'en', 'de') as lang", "concat(if(id % 3 = 0, 'the ', 'das '), translate(cast(id as string), '0123456789', 'abcdefghij')) as text")
    d = language.learn(rows)
    assert d.names == ["DE", "EN"] and np.allclose(np.exp(d.shares), [2 / 3, 1 / 3], rtol=0, atol=1e-12)
    size = d.weights.shape[1]
    counts = np.full((2, size), 0.5)
    for r in rows.collect():
        np.add.at(counts[int(r.lang == "en")], language.buckets(r.text, size), 1)
    assert np.array_equal(d.weights, np.log(counts / counts.sum(1, keepdims=True)))
