"""Offset-mapped token counts: each document is encoded once as a whole, and its tokens'
spans are joined to the spans of its sections.

The byte-level vocabulary is lossless, so token offsets are running sums of token lengths.
Sections and tokens are both sorted within a document: the interval join is a binary
search. Rules for a token that crosses a boundary:
  'majority' - the section that holds most of its bytes gets it, the earlier on ties;
  'start'    - the section of its first byte gets it;
  'fraction' - each section gets the share of its bytes.
Sections are lines with their line feed or sentences with the spaces behind them; they
cover the text without gaps, so the sections' counts add up to the document's.

Defined results: null and empty texts have no tokens and no sections; ids may repeat or be
null (row by row); other columns are ignored. Whole texts are encoded,
whatever their length.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_blocks, documents

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(2)
def encoder(path: str, pattern: str):
    """The encoding and the byte length of each id; once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


_SENTENCE = re.compile(rb"\n|[.!?]\x20+")


def section_bounds(data: bytes, sections: str = "sentence") -> np.ndarray:
    """Byte offsets 0 = b0 < b1 < ... = len: a section ends after each line feed and, for sentences, after the spaces behind a full stop."""
    if sections == "line":
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    else:
        ends = [m.end() for m in _SENTENCE.finditer(data)]
    return np.unique(np.concatenate([[0], ends, [len(data)]]).astype(np.int64))


def allocate(bounds: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section and the number of crossing tokens: bounds are the sections' n+1 byte bounds, ends the tokens' end offsets."""
    n = len(bounds) - 1
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends, "left") - 1
    out = np.bincount(first[first == last], minlength=n).astype(float)
    cross = np.flatnonzero(first != last)
    two = cross[last[cross] == first[cross] + 1]
    cut = bounds[first[two] + 1]
    before, after = cut - starts[two], ends[two] - cut
    if rule == "fraction":
        np.add.at(out, first[two], before / (before + after))
        np.add.at(out, last[two], after / (before + after))
    else:
        np.add.at(out, np.where((before >= after) | (rule == "start"), first[two], last[two]), 1)
    for i in np.setdiff1d(cross, two):  # tokens over three sections or more
        shares = np.array([min(bounds[k + 1], ends[i]) - max(bounds[k], starts[i]) for k in range(first[i], last[i] + 1)], float)
        if rule == "fraction":
            out[first[i] : last[i] + 1] += shares / shares.sum()
        else:
            out[first[i] + (int(shares.argmax()) if rule == "majority" else 0)] += 1
    return out, len(cross)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "majority", sections: str = "sentence", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Per row of docs: id, n_tokens, n_crossing and sections (start and end in code points, tokens)."""
    if rule not in ("majority", "start", "fraction"):
        raise ValueError(f"unknown rule {rule!r}")
    if sections not in ("sentence", "line"):
        raise ValueError(f"unknown sections {sections!r}")
    section = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("tokens", pa.float64())])

    def block(b: pa.RecordBatch) -> pa.RecordBatch:
        enc, lengths = encoder(vocabulary, pattern)
        totals, crossing, found = [], [], []
        for text in b.column(1).to_pylist():
            if not text:
                totals.append(0), crossing.append(0), found.append([])
                continue
            data = text.encode("utf-8", "surrogatepass")
            ends = np.cumsum(lengths[np.array(enc.encode_ordinary(text), np.int64)])
            bounds = section_bounds(data, sections)
            chars = bounds if len(data) == len(text) else np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])[bounds]
            counts, n = allocate(bounds, ends, rule)
            totals.append(len(ends))
            crossing.append(n)
            found.append([{"start": s, "end": e, "tokens": t} for s, e, t in zip(chars[:-1].tolist(), chars[1:].tolist(), counts.tolist(), strict=True)])
        return pa.record_batch([b.column(0), pa.array(totals, pa.int64()), pa.array(crossing, pa.int64()), pa.array(found, pa.list_(section))], ["id", "n_tokens", "n_crossing", "sections"])

    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"id {dict(src.dtypes)['id']}, n_tokens long, n_crossing long, sections array<struct<start:long,end:long,tokens:double>>"
    return by_blocks(src, block, schema).withColumnRenamed("id", id_col)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: totals and the token count of each section, in order."""
    out = token_counts(documents(spark, sf_dir))
    return out.select("doc_id", "n_tokens", "n_crossing", F.size("sections").cast("long").alias("n_sections"), F.expr("transform(sections, s -> cast(s.tokens as long))").alias("section_tokens"))
