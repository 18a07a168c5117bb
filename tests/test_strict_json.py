"""The JVM's strict objects against the standard library's parser, on listed cases and on a fuzz corpus."""

import json
import random

from pyspark.sql import functions as F

from tidewell.functions.strict_json import strict_object

KEYS = ["a", "b"]
LISTED = [
    None, "", " ", "{", "}", "{}", "[]", "1", '"a"', "null", '{"a":1,"b":2}', ' \t\r\n{"a" : "x" , "b" : null } \n', '{"a":1,"b":2} x', '{"a":1,"b":2}}', '{"a":1,"b":2},', '{"a":1}', '{"a":1,"a":"z","b":2}',
    "{'a':1,'b':2}", '{"a":1,"b":2,}', '{"a":1,,"b":2}', '{"a" 1,"b":2}', '{"a":01,"b":2}', '{"a":-0,"b":-}', '{"a":1.,"b":2}', '{"a":.5,"b":2}', '{"a":1e5,"b":-1.5E-3}', '{"a":NaN,"b":-Infinity}', '{"a":nan,"b":1}',
    '{"a":[1,[2,{"a":3,"b":[]}]],"b":{"a":"in","c":{}}}', '{"a":[1,],"b":2}', '{"a":[,],"b":2}', '{"a":[1 2],"b":2}', '{"a":[1}, "b":2]', '{"c":{"a":1,"b":2}}', '{"c":[{"a":1}],"a":true,"b":false}', '{"a":tru,"b":1}',
    '{"\\u0061":"esc","b":"\\n\\t\\"\\\\\\/"}', '{"a":"\\x","b":1}', '{"a":"\\u12","b":1}', '{"a":"tab\there","b":1}', '{"a":"line\nfeed","b":1}', '{"a":"\\ud83d\\ude00","b":"\\u00e9é😀"}', '{"a":"\\ud83d","b":1}', '{"a":"\\ude00","b":1}',
    '{"a":"\\ud83d\\ud83d\\ude00","b":1}', '{"a":"\\ud83d\\\\\\ude00","b":1}', '{"a":"\\\\ud83d","b":1}', '{"a":["\\ud83d"],"b":1}', '﻿{"a":1,"b":2}', '{"a":1,"b":2} ', '{"a":1/*c*/,"b":2}', '{"a":"","b":""}', '{"":1,"a":2,"b":3}',
    '{"a":"unclosed,"b":1}', '{"a":"x","b":"y"', '{a:1,"b":2}', '{"a":1,"b":2}\n{"a":1,"b":2}', '{"a":{"b":1},"b":{"a":2},"a":{"x":[{}]}}', '{1:2,"a":1,"b":1}', '{"a":--1,"b":1}', '{"a":+1,"b":1}', '{"a":1e,"b":1}', '{"a":\x7f,"b":1}', '{"a":"\x7f","b":1}', '{"a":"null","b":null}',
    '{"a":' + "[" * 400 + "]" * 400 + ',"b":1}', '{"a":' + "9" * 4301 + ',"b":1}', '{"a":' + "9" * 4300 + ',"b":1}', '{"a":"' + "\\n" * 60000 + '","b":"' + "x" * 120000 + '"}', '{"a":"q","b":' + json.dumps(list(range(3000))) + "}",
]


def expected(t):
    try:
        found = json.loads(t)
        got = [found[k] for k in KEYS]
        "".join(g for g in got if isinstance(g, str)).encode()
        return got
    except Exception:
        return None


def same(cell, want):
    if want is None or isinstance(want, str):
        return cell == want
    return cell is not None and repr(json.loads(cell)) == repr(want)


def agree(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(4)
    got = {r.i: r.o for r in rows.select("i", strict_object(F.col("t"), KEYS).alias("o")).collect()}
    passed = 0
    for i, t in enumerate(texts):
        want = expected(t)
        assert got[i].ok == (want is not None), t and t[:200]
        cells = [got[i].v0, got[i].v1]
        assert cells == [None, None] if want is None else all(map(same, cells, want)), t[:200]
        passed += want is not None
    return passed


def test_listed_cases(spark):
    assert agree(spark, LISTED) >= 15


def test_fuzz_corpus(spark):
    rng = random.Random(5)
    seeds = [t for t in LISTED if t and len(t) < 200] + ['{"a":"x","b":["p","q"]}', '{"b":{"k":[1,2.5,null]},"a":"\\u00e4"}', '{"a":null,"c":"}","b":"{"}']
    marks, texts = list('{}[]:,"\\ \n0159-+.eEaubtfn') + ["true", "null", '"a"', '"b"', '\\u00e9', "é"], []
    for _ in range(6000):
        t = list(rng.choice(seeds))
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            at = rng.randrange(len(t) + 1)
            what = rng.random()
            if what < 0.4:
                t.insert(at, rng.choice(marks))
            elif what < 0.7 and t:
                t.pop(min(at, len(t) - 1))
            elif t:
                t[min(at, len(t) - 1)] = rng.choice(marks)
        texts.append("".join(t))
    assert agree(spark, texts) > 300


def test_too_deep_and_no_worker(spark):
    rows = spark.createDataFrame([('{"a":' + "[" * 600 + "]" * 600 + ',"b":1}',)], "t string").select(strict_object(F.col("t"), KEYS).alias("o"))
    assert rows.first().o.ok is False
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
