"""License scan: MinHash bands over overlapping word windows retrieve templates, exact
shingle containment verifies them; DataFrame and SQL functions only.

A template of m words has k-word shingles, k = min(5, m). Windows for it hold m + stride - 1
words, stride m // 2 + 1, so every run of m words lies in some window; a window that
contains the template at 0.8 or more has a Jaccard similarity of at least 0.8 / (2 + 0.2)
or so to it, and with `bands` bands of one row each (32) it collides with probability
1 - (1 - 0.36)^32 > 0.999999.

A one-row band collides only if the window holds the template's own least shingle under
that band's hash. So only windows that hold such a shingle get their MinHash computed; for
all others the outcome, no collision, is known. The templates are a parameter of bounded
size (`MAX_TEMPLATES`) and travel as literals; nothing but the result is shuffled.

Defined results: null and empty texts have no matches; a template counts once per row of
the table, at its first best window among those that stay: an incomplete match is dropped only if its matched
words overlap those of a better match (one that shares more shingles), of another template, that stays; ids may repeat or be null (row by row, rows equal in
id and text are returned as often as they stand there); other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .license_texts import TEXTS

#: Usual notices, by licence; whole texts stand beside them.
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "all-rights-reserved": "All rights reserved.",
    **TEXTS,
}
MAX_TEMPLATES = 500
SHINGLE = 5
_WORD = "[a-z0-9]+"


def _shingles(words: str, k: int) -> str:
    """SQL: the hashes of all k-word shingles of an array of words."""
    parts = ", ".join(f"get({words}, i + {j})" for j in range(k))
    return f"transform(if(size({words}) >= {k}, sequence(0, size({words}) - {k}), cast(array() as array<int>)), i -> xxhash64({parts}))"


def _minhash(shingles: str, bands: int) -> str:
    return f"transform(sequence(0, {bands - 1}), b -> array_min(transform({shingles}, x -> xxhash64(x, b))))"


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", bands: int = 32, containment: float = 0.8) -> DataFrame:
    """Per row of docs: id and `matches`, an array of (license, containment, first_word) by license."""
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates: scan in several calls")
    sized: dict[int, dict[str, list[str]]] = {}
    for name, text in templates.items():
        words = re.findall(_WORD, text.lower())
        if words:
            sized.setdefault(len(words), {})[name] = words
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    src = src.select("id", F.xxhash64("id", "text").alias("rk"), F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(_WORD), F.lit(0)).alias("w"))
    found, anchors = {}, {}
    rows = [(m, name, words) for m, group in sized.items() for name, words in group.items()]
    table = None
    if rows:
        base = spark.createDataFrame(rows, "m int, license string, words array<string>")
        cases = "case " + " ".join(f"when m = {m} then {_shingles('words', min(SHINGLE, m))}" for m in sized) + " end"
        table = base.selectExpr("m", "license", "words", f"{cases} as every").selectExpr("m", "license", "words", "every", "array_distinct(every) as sh").selectExpr("m", "license", "words", "every", "sh", f"{_minhash('sh', bands)} as mins")
        # The shingle that is least under a band's hash, for each band.
        least = table.selectExpr("m", f"explode(transform(sequence(0, {bands - 1}), b -> filter(sh, x -> xxhash64(x, b) = mins[b])[0])) as h", "every", "words").selectExpr("m", "h", f"slice(words, cast(array_position(every, h) as int), least(m, {SHINGLE})) as words").distinct()
        for r in least.collect():
            found.setdefault(r.m, []).append(r.h)
            anchors.setdefault(min(SHINGLE, r.m), set()).add(max(r.words, key=len))
        found = {m: sorted(set(hs)) for m, hs in found.items()}
        table = table.select("m", "license", "sh", "mins")
    arrays = []
    for k in sorted({min(SHINGLE, m) for m in found}):
        keys = sorted({h for m, hs in found.items() if min(SHINGLE, m) == k for h in hs})
        # A text without the longest word of any such shingle holds none of them.
        able = f"arrays_overlap(w, array({', '.join(map(repr, sorted(anchors[k])))}))"
        src = src.withColumn(f"at{k}", F.expr(f"if({able}, filter(transform({_shingles('w', k)}, (h, i) -> struct(i as i, h as h)), x -> x.h in ({', '.join(f'{h}L' if h != -(2**63) else 'cast(-9223372036854775808 as bigint)' for h in keys)})), cast(array() as array<struct<i:int,h:bigint>>))"))
    for m, hs in found.items():
        k, stride = min(SHINGLE, m), m // 2 + 1
        width = m + stride - 1
        mine = f"filter(at{k}, x -> x.h in ({', '.join(f'{h}L' for h in sorted(hs))}))"
        starts = f"array_distinct(flatten(transform({mine}, x -> sequence(cast(greatest(0, ceil((x.i - {width - k}) / {stride})) as int), cast(floor(x.i / {stride}) as int)))))"
        arrays.append(f"transform({starts}, j -> struct({m} as m, j * {stride} as start, slice(w, j * {stride} + 1, {width}) as words))")
    if not arrays:
        return src.select(F.col("id").alias(id_col), F.expr("cast(array() as array<struct<license:string,containment:double,first_word:int>>)").alias("matches"))
    any_at = " or ".join(f"size(at{k}) > 0" for k in sorted({min(SHINGLE, m) for m in found}))
    wins = src.selectExpr("id", "rk", f"if({any_at}, concat({', '.join(arrays)}), null) as wins").withColumn("row", F.monotonically_increasing_id()).selectExpr("id", "rk", "row", "explode_outer(wins) as win")
    cases = "case " + " ".join(f"when win.m = {m} then {_shingles('win.words', min(SHINGLE, m))}" for m in sized) + " end"
    wins = wins.selectExpr("id", "rk", "row", "win.m as wm", "win.start as start", f"{cases} as wsh").selectExpr("*", f"if(wsh is null, null, {_minhash('wsh', bands)}) as wmins")
    hits = wins.join(F.broadcast(table), F.expr("wm = m and exists(arrays_zip(wmins, mins), z -> z.wmins = z.mins)"), "left")
    share = "size(array_intersect(sh, wsh)) / size(sh)"
    shared = f"if({share} >= {containment}, filter(transform(wsh, (x, i) -> if(array_contains(sh, x), i, null)), i -> i is not null), null)"
    # The words a match covers: those of the shared shingles in the run of m words with most of them, the first such run.
    inside = f"filter(at, i -> i >= p and i <= p + m - least(m, {SHINGLE}))"
    run = f"array_max(transform(at, p -> struct(cast(size(array_distinct(transform({inside}, i -> wsh[i]))) as double) as o, -p as p)))"
    words = f"array_distinct(flatten(transform({inside}, i -> sequence(start + i, start + i + least(m, {SHINGLE}) - 1))))"
    hits = hits.selectExpr("id", "rk", "row", "m", "license", "sh", "wsh", "start", f"{share} as share", f"{shared} as at").selectExpr("*", f"{run} as run").selectExpr("*", "-run.p as p")
    hits = hits.selectExpr("id", "rk", "row", f"if(at is not null, struct(-run.o as o, start as start, license as license, share as share, {words} as words, run.o >= size(sh) as whole), null) as hit")
    # One row per row and window: folded map-side, by row and then by licence, without a hot key.
    best = hits.groupBy("id", "rk", "row").agg(F.collect_set("hit").alias("hits"))
    # Best matches first, by how many shingles their run shares, so that a whole text comes before a notice within it: one stays if it is complete, or unless it shares words with a better one, of another licence, that stays.
    rival = "exists(kept, y -> y.o < x.o and y.license <> x.license and arrays_overlap(y.words, x.words))"
    kept = f"aggregate(array_sort(hits), cast(array() as array<struct<o:double,start:int,license:string,share:double,words:array<int>,whole:boolean>>), (kept, x) -> if(not x.whole and {rival}, kept, concat(kept, array(x))))"
    best = best.selectExpr("id", f"{kept} as kept")
    one = "transform(array_sort(array_distinct(transform(kept, x -> x.license))), l -> struct(l as license, array_max(transform(filter(kept, x -> x.license = l), x -> struct(x.share as share, -x.start as at))) as top))"
    return best.selectExpr(f"id as `{id_col}`", f"transform({one}, x -> struct(x.license as license, x.top.share as containment, -x.top.at as first_word)) as matches")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the licences found, their containment, and the word each window starts at."""
    return license_scan(documents(spark, sf_dir)).selectExpr("doc_id", "cast(size(matches) as long) as n_licenses", "array_join(matches.license, ',') as licenses", "array_min(matches.containment) as least_containment", "matches.first_word as first_words")
