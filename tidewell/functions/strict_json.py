"""Strict JSON objects on the JVM: a pushdown automaton folded over tokens that one pattern cuts.

from_json forgives trailing text, single quotes, leading zeros and repeated keys; model answers
must not be read that way. Nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRING = r'"[^"\\\x00-\x1F]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1F]*+)*+"'
_VALUE = r"-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+|true|false|null|NaN|-?+Infinity"
#: Strings, other plain values, marks, white space, and whatever else stands there.
TOKENS = rf'{_STRING}|{_VALUE}|[{{}}\[\]:,]|[\x20\t\n\r]++|[^"0-9tfnNI{{}}\[\]:,\x20\t\n\r-]++|[\s\S]'
#: What is open may be this deep; an integer may have this many digits.
DEPTH, DIGITS = 500, 4300
#: State, kind of token (s a string, v another value) and, at the end of a value, what is open: whether something opens (+) or closes (-), and the next state. O wants the object, K a key or the end, k a key, C a colon, V a value, A a value or the end, E a comma or the end. What isn't here is an error, X.
MOVES = {
    "O{": "+K", "Ks": "=C", "ks": "=C", "K}": "-E", "C:": "=V",
    "V{": "+K", "V[": "+A", "Vs": "=E", "Vv": "=E",
    "A{": "+K", "A[": "+A", "As": "=E", "Av": "=E", "A]": "-E",
    "E,{": "=k", "E,[": "=V", "E}{": "-E", "E][": "-E",
}


def _decoded(token: Column) -> Column:
    """The text of a string token."""
    return F.when(token.contains("\\"), F.get(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), F.lit(0))).otherwise(F.substring(token, F.lit(2), F.length(token) - 2))


def _no_text(token: Column) -> Column:
    """Whether a string token has half a surrogate pair."""
    plain = F.regexp_replace(token, r"\\\\", " ")
    high, low = r"\\u[dD][89abAB][0-9a-fA-F]{2}", r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    return token.contains("\\u") & plain.rlike(f"{high}(?!{low})|(?<!{high}){low}")


def strict_object(text: Column, keys: list[str]) -> Column:
    """struct(ok, v0, v1, ...): the values of the keys in a text that is one JSON object and nothing else.

    A string gives its text, null gives null, any other value its JSON text without white space.
    ok is false, and all values null, for a null text, anything that isn't strict JSON (NaN and
    Infinity are allowed, control characters in strings aren't), a key that is missing, a wanted
    string with half a surrogate pair, integers of more than 4,300 digits or nesting deeper than
    500. Of repeated keys the last counts. The fold's state is of constant size but for what is
    open, so the work is linear in the text.
    """
    at_start = text.rlike(r"^[\x20\t\n\r]*+\{")
    cut = F.when(at_start, F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.get(F.transform(F.array(F.filter(cut, lambda t: ~t.rlike(r"^[\x20\t\n\r]"))), lambda tokens: _judged(tokens, keys)), F.lit(0))


def _judged(tokens: Column, keys: list[str]) -> Column:
    moves = F.create_map(*[F.lit(x) for move in MOVES.items() for x in move])
    names = [f"{side}{i}" for i in range(len(keys)) for side in "se"]
    start = F.struct(F.lit("").alias("open"), F.lit("O").alias("state"), F.lit(-1).alias("key"), F.lit(0).alias("at"), *[F.lit(-1).alias(n) for n in names])

    def kind(t: Column) -> Column:
        whole = t.rlike("^-?[0-9]++$") & (F.length(F.ltrim(t, F.lit("-"))) > DIGITS)
        return F.when(t.isin(*"{}[]:,"), t).when(t.startswith('"') & (F.length(t) > 1), "s").when(t.rlike("^(?:-?[0-9]|[tfnNI-]..)") & ~whole, "v").otherwise("x")

    def moved(a: Column, t: Column, move: Column) -> Column:
        op, state = F.substring(move, 1, 1), F.substring(move, 2, 1)
        opened = F.when(op == "+", F.concat(a["open"], t)).when(op == "-", F.substring(a["open"], F.lit(1), F.length(a["open"]) - 1)).otherwise(a["open"])
        state = F.when(F.length(a["open"]) >= DEPTH, F.when(op == "+", "X").otherwise(state)).otherwise(state)
        outer = F.length(a["open"]) == 1
        named = F.lit(-1)
        for i, k in enumerate(keys):
            named = F.when(_decoded(t) == k, i).otherwise(named)
        key = F.when(outer & a["state"].isin("K", "k") & (state == "C"), named).otherwise(a["key"])
        spans = []
        for i in range(len(keys)):
            mine = a["key"] == i
            spans.append(F.when(mine & outer & (a["state"] == "V"), a["at"]).otherwise(a[f"s{i}"]).alias(f"s{i}"))
            ends = mine & (state == "E") & (F.length(opened) == 1)
            spans.append(F.when(ends, a["at"]).otherwise(a[f"e{i}"]).alias(f"e{i}"))
        return F.struct(opened.alias("open"), state.alias("state"), key.alias("key"), (a["at"] + 1).alias("at"), *spans)

    def step(a: Column, t: Column) -> Column:
        rule = F.concat(a["state"], kind(t), F.when(a["state"] == "E", F.substring(a["open"], -1, 1)).otherwise(""))
        move = F.coalesce(F.element_at(moves, rule), F.lit("=X"))
        return F.when(a["state"] == "X", a).otherwise(F.get(F.transform(F.array(move), lambda m: moved(a, t, m)), F.lit(0)))

    def finished(a: Column) -> Column:
        values, fine = [], (a["state"] == "E") & (a["open"] == "")
        for i in range(len(keys)):
            first = F.get(tokens, a[f"s{i}"])
            single = first.startswith('"')
            fine = fine & (a[f"s{i}"] >= 0) & ~(single & _no_text(first))
            values.append(F.when(single, _decoded(first)).when(first != "null", F.array_join(F.slice(tokens, a[f"s{i}"] + 1, F.greatest(a[f"e{i}"] - a[f"s{i}"] + 1, F.lit(0))), "")))
        fine = F.coalesce(fine, F.lit(False))
        return F.struct(fine.alias("ok"), *[F.when(fine, v).alias(f"v{i}") for i, v in enumerate(values)])

    return F.aggregate(tokens, start, step, finished)
