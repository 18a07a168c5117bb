"""Scalar functions on instruction text: JVM-side expressions, but for the keyword search."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: What Python's str.strip() and \s take as white space.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_CHARACTERS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Words that announce a task.
PREFIXES = ["Task", "Prompt", "Original Prompt", "Question", "The Problem", "Problem", "Scenario", "The senario", "Situation", "The situation", "Context", "Challenge", "Query", "Request", "Instructions", "Instruction", "Descriptions", "Description"]
#: What begins an answer, and a solution step.
MARKERS = ["Answer:", "Answers:", "The answer is", "Correct answer", "The correct answer", "Answer is", "Explanation:", "Here are some", "Solution Approach:", "Solution:"]
STEPS = ["# Step 1", "## Step 1", "### Step 1"]
_WORDS = "|".join(x for w in PREFIXES for x in (f"{w}:", rf"\*\*{w}\*\*", f"## {w}:"))
_NUMBERED = r"Question \p{Nd}+:|Question \p{Nd}+\.|Part \p{Nd}+:|Q\p{Nd}+\.|Q\p{Nd}+:"
_PREFIX = rf"(?iu)\A(?:{_WORDS}|{_NUMBERED}){WS}*"
_NUMBER = rf"\A(?:\p{{Nd}}+\.|[\p{{L}}\p{{N}}_]+\)){WS}*"
_ASSISTANT = "(?:" + "|".join(MARKERS) + ")s?:"
_STEP = "(?:" + "|".join(STEPS) + "):?"


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(WS_CHARACTERS))


def remove_prefix(s: Column) -> Column:
    """Without a leading number or letter mark and, after that, without one leading task word."""
    return strip(F.regexp_replace(strip(F.regexp_replace(s, _NUMBER, "")), _PREFIX, ""))


def _until(s: Column, mark: str) -> Column:
    return F.substring_index(s, mark, 1)


def _bare(s: Column) -> Column:
    """Bold marks go only where the first stands at the second character."""
    s = strip(s)
    return F.when(F.instr(s, "**") == 2, strip(F.replace(s, F.lit("**"), F.lit("")))).otherwise(s)


def sanitize(text: Column, family: str) -> Column:
    """struct(instruction, class) by the decision table of the model family, whose name holds gemma-2 or llama-3; others stay as they are, class 0.

    The place of an answer or step mark is found before the second prefix removal and used
    after it, as the table has it.
    """
    family = family.lower()
    if "gemma-2" not in family and "llama-3" not in family:
        return F.struct(text.alias("instruction"), F.lit(0.0).alias("class"))
    llama = "gemma-2" not in family
    low = F.lit("")

    def place(s: Column, words: list[str], pattern: str) -> Column:
        """Characters before the first mark; the pattern is tried once, and only where one of its words occurs at all."""
        parts = F.when(reduce(Column.__or__, [s.contains(w) for w in words]), F.split(s, pattern, 2))
        return F.get(F.transform(F.array(parts), lambda x: F.when(F.size(x) > 1, F.length(F.get(x, F.lit(0))))), F.lit(0))

    def decide(x: Column) -> Column:
        first, s, mark, step = x["first"], x["second"], x["mark"], x["step"]
        head = strip(_until(s, "\n"))
        asks = s.contains("?")
        question = lambda t, drop: F.concat(strip(F.replace(_until(t, "?"), F.lit(drop), low)), F.lit("?"))
        upto = F.concat(strip(_until(s, "?")), F.lit("?"))
        bold = lambda t: F.when(F.instr(t, "**") == 2, strip(F.replace(t, F.lit("**"), low))).otherwise(strip(t))
        plain = strip(F.replace(head, F.lit("*"), low))
        out = lambda t, c: F.struct(t.alias("t"), F.lit(c).alias("class"))
        rule = F.when(first.startswith("*") & first.contains("?"), out(question(first, "*"), 1.0))
        rule = rule.when(s.startswith('"') & asks, out(question(s, '"'), 2.1))
        rule = rule.when(s.startswith('"'), out(strip(F.replace(strip(F.replace(_until(s, "\n"), F.lit('"'), low)), F.lit("*"), low)), 2.2))
        rule = rule.when(s.startswith("<b>"), out(strip(F.replace(s, F.lit("*"), low)), 3.0))
        rule = rule.when(mark.isNotNull(), out(_bare(F.substring(s, F.lit(1), mark)), 4.0))
        if llama:
            rule = rule.when(step.isNotNull(), out(_bare(F.substring(s, F.lit(1), step)), 5.0))
        a, b, c, d, e = (6.1, 6.2, 6.3, 99.1, 99.2) if llama else (5.1, 5.2, 5.3, 6.1, 6.2)
        colon = head.endswith(":")
        rule = rule.when(colon & s.contains("#"), out(_bare(_until(s, "#")), a)).when(colon & asks, out(bold(upto), b)).when(colon, out(plain, c))
        return rule.when(asks, out(bold(upto), d)).otherwise(out(plain, e))

    one = F.transform(F.array(remove_prefix(text)), lambda f: F.struct(f.alias("first"), remove_prefix(f).alias("second"), place(f, MARKERS, _ASSISTANT).alias("mark"), (place(f, STEPS, _STEP) if llama else F.lit(None).cast("int")).alias("step")))
    got = F.transform(F.transform(one, decide), lambda r: F.struct(remove_prefix(r["t"]).alias("instruction"), r["class"].alias("class")))
    return F.get(got, F.lit(0))


def cut_at_stop(text: Column, tokens: list[str]) -> Column:
    """Up to a stop token: of those present the last listed wins, each cut starting from the whole text."""
    out = text
    for t in tokens:
        out = F.when(text.contains(t), _until(text, t)).otherwise(out)
    return out


def mcq_end(text: Column) -> Column:
    """struct(is_mcq, end): at least four option marks, and where the last one ends (code points), else -1."""
    # Fixed value: what an option mark looks like.
    mark = r"(?iu)\([A-D]\)|[A-D][.)]|[a-d][.)]"
    parts = F.split(text, mark)
    tail = F.length(F.element_at(parts, -1))
    many = F.regexp_count(text, F.lit(mark)) >= 4
    return F.struct(many.alias("is_mcq"), F.when(many, F.length(text) - tail).otherwise(-1).alias("end"))


def next_newline(text: Column) -> Column:
    return F.instr(text, "\n") - 1


def demo_clean(text: Column, template: Column) -> Column:
    """First line of what follows the template."""
    return _until(F.substring(text, F.length(template) + 1, F.length(text)), "\n")


def repair_tags(text: Column) -> Column:
    """Offline tag output: an opening brace before, nothing after the last closing one; none gives the empty text."""
    return F.regexp_extract(F.concat(F.lit("{\n"), text), r"(?s)^.*\}", 0)


def repair_tags_api(text: Column) -> Column:
    return F.concat(F.lit("{"), text, F.lit("}"))


def uuid5(text: Column) -> Column:
    """Version 5 UUID in the DNS name space."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.encode(text, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


#: What marks texts on mathematics, and on code.
MATH_KEYWORDS = [
    "radius", "diameter", "circumference", "perimeter", "triangle", "rectangle",
    "algebra", "geometry", "calculus", "trigonometry", "set theory", "linear regression",
    "number theory", "graph theory", "topology", "differential equations", "integral", "derivative",
    "logarithm", "exponent", "polynomial", "quadratic", "vector", "matrix", "determinant", "eigenvalue",
    "eigenvector", "complex number", "real number", "rational number", "irrational number", "prime number",
    "factorial", "permutation", "combination", "binomial", "continuity", "eigen vector",
    "domain", "range", "inverse", "composition", "angle", "radian", "sine",
    "cosine", "tangent", "cotangent", "secant", "cosecant", "pythagorean theorem", "euclidean geometry",
    "non-euclidean geometry", "hyperbolic geometry", "elliptic geometry", "fractal", "chaos theory",
    "golden ratio", "fibonacci sequence", "pascal's triangle", "binomial theorem", "fourier series",
    "laplace transform", "z-transform", "normal distribution", "poisson distribution", "chi-square distribution",
    "Student's t-distribution", "confidence interval", "hypothesis testing", "p-value", "bayes' theorem",
    "law of large numbers", "central limit theorem", "regression analysis", "correlation coefficient",
    "covariance", "ANOVA", "chi-square test", "t-test", "F-test", "Mann-Whitney U test", "Kolmogorov-Smirnov test",
    "Wilcoxon signed-rank test", "Kruskal-Wallis test", "Fisher's exact test", "McNemar's test", "Spearman's rank correlation",
    "Kendall's tau", "Pearson's correlation", "linear programming", "integer programming", "dynamic programming",
]
CODE_KEYWORDS = [
    "Python", "Java", "in C", "C++", "C#", "JavaScript", "Ruby", "PHP", "Swift", "Objective-C",
    "Kotlin", "in Go", "Rust", "Lua", "Perl", "MATLAB", "Fortran", "Julia", "TypeScript",
    "F#", "Bash", "PowerShell", "SQL", "HTML", "CSS", "XML", "YAML", "JSON",
    "Markdown", "LaTeX", "Assembly", "VBA", "Pascal",
    "in D", "in R", "Solidity", "Verilog", "VHDL", "Visual Basic", "BASIC",
    "\n\n```", "\n```", "```", "import ", "def", "elif", "#include",
]


def has_keyword(text: Column, words: list[str], ignore_case: bool = True) -> Column:
    """Whether the text holds one of the words. One automaton for all words reads the text once, in Arrow batches; lower-casing stays on the JVM."""
    from ..operators.batches import small_batches

    small_batches(SparkSession.active())
    kept = sorted({w.lower() if ignore_case else w for w in words})
    low = F.lower(text) if ignore_case else text
    if not kept:
        return F.when(low.isNotNull(), False)
    pattern = "|".join("".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in w) for w in kept)

    def holds(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, pattern)

    return F.arrow_udf(holds, "boolean")(low)
