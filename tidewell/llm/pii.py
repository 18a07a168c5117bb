"""PII spans: regular expressions propose, checksums confirm, nearby words adjust the score.

Base kinds are email, ip, card and phone; they always stay in the result once their
own rule (parts, Luhn, digit count) holds. The method adds `iban` (confirmed by mod-97),
`ssn` (three-two-four digits) and `secret` (a run of 20 to 256 letters, digits, _ and - that
holds letters and digits both, as keys and tokens do); the last two are kept only if their
score reaches `min_score`, which takes a context word within NEAR code points. Positions count
code points, ends are exclusive.

Defined results: null and empty texts have no spans; an empty table gives an empty result;
rows are handled one by one, whether ids repeat or are null; spans of different kinds may
overlap; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import by_blocks, documents

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match can only start where a run of digits starts, so the look-behind changes no match and keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,256}+(?![A-Za-z0-9_-])")
CONTEXT = {
    "email": ("mail", "contact", "courriel", "correo", "write", "adresse"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "telefon", "fax", "appel"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "tax"),
    "secret": ("token", "key", "secret", "password", "passwd", "api", "auth", "bearer", "credential", "credentials"),
}
PRIOR = {"email": 0.9, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "secret": 0.3}
NEAR, LIFT = 40, 0.3
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str):
    done = at = 0
    while (at := text.find("@", max(at, done))) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at += 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def score(text: str, kind: str, start: int, end: int) -> float:
    """Prior of the kind, lifted if one of its context words stands within NEAR code points."""
    around = text[max(0, start - NEAR) : start].lower() + " " + text[end : end + NEAR].lower()
    words = set(_WORD.findall(around))
    return round(min(1.0, PRIOR[kind] + LIFT * any(w in words for w in CONTEXT[kind])), 2)


def find(text: str | None, min_score: float = 0.5) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score), by start, then kind as listed in KINDS."""
    if not text:
        return []
    found = [("email", *x) for x in _emails(text)] if "@" in text else []
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    out = [(k, s, e, score(text, k, s, e)) for k, s, e in found]
    out += [("iban", *m.span(), score(text, "iban", *m.span())) for m in _IBAN.finditer(text) if mod97(m.group())]
    out += [("ssn", *m.span(), p) for m in _SSN.finditer(text) if (p := score(text, "ssn", *m.span())) >= min_score]
    out += [("secret", *m.span(), p) for m in _SECRET.finditer(text) if (p := score(text, "secret", *m.span())) >= min_score]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """One row per row of docs: the id and `spans`, an array of (kind, start, end, score)."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def block(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in find(t, min_score)] for t in b.column(1).to_pylist()]
        return pa.record_batch([b.column(0), pa.array(rows, pa.list_(span))], ["id", "spans"])

    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = dict(src.dtypes)["id"]
    return by_blocks(src, block, f"id {kind}, spans array<struct<kind:string,start:long,end:long,score:double>>").withColumnRenamed("id", id_col)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(documents(spark, sf_dir))
    joined = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    base = f"filter(spans, x -> x.kind in {BASE!r})"
    counts = {k: f"cast(size(filter(spans, x -> x.kind = '{k}')) as long) as n_{k}" for k in KINDS}
    extra = [*(counts[k] for k in KINDS if k not in BASE), "cast(size(spans) as long) as n_spans", "array_join(transform(spans, x -> cast(x.score as string)), ',') as scores"]
    return found.selectExpr("doc_id", *(counts[k] for k in BASE), f"sha2({joined.format(base)}, 256) as base_sha256", f"{joined.format('spans')} as spans", *extra)
