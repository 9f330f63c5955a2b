"""Text functions that no built-in expresses, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Abbreviations whose points don't end a sentence.
PROTECTED = ("Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "vs.", "etc.", "i.e.", "e.g.", "et al.", "Inc.", "Ltd.", "Co.", "U.S.", "U.K.", "a.m.", "p.m.")
_SHORT = re.compile("|".join(re.escape(a) for a in PROTECTED))
_END = re.compile(r"([.!?])[\"']*(?=\s|$)")


def split_sentences(text: str | None) -> list[str]:
    """Sentences ending in ., ! or ? with quotes, before white space or the end; points of abbreviations don't count, sentences of three characters or fewer are dropped."""
    if not text:
        return []
    spared = {k for m in _SHORT.finditer(text) for k in range(*m.span()) if text[k] == "."}
    cuts = [m.end() for m in _END.finditer(text) if m.start() not in spared]
    parts = (text[a:b].strip() for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True))
    return [p for p in parts if len(p) > 3]


def batches(sentences: list[str], most: int = 1200) -> list[str]:
    """Numbered sentences packed into batches of at most `most` characters; a longer one stands alone."""
    out, cur, size = [], [], 0
    for n, s in enumerate(sentences, 1):
        line = f"[{n}] {s}"
        if cur and size + len(line) + 1 > most:
            out.append("\n".join(cur))
            cur, size = [], 0
        cur.append(line)
        size += len(line) + 1
    return [*out, "\n".join(cur)] if cur else out


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentences_udf(x: pd.Series) -> pd.Series:
    return x.map(split_sentences)


@F.pandas_udf(T.ArrayType(T.StringType()))
def batches_udf(x: pd.Series) -> pd.Series:
    return x.map(lambda t: batches(split_sentences(t)))


def fuzzy_ratio(a: str | None, b: str | None) -> float:
    """200 LCS / (len a + len b): similarity by insertions and deletions, 100 for two empty texts."""
    if a is None or b is None:
        return 0.0
    if not a and not b:
        return 100.0
    if a == b:
        return 100.0
    # longest common subsequence by bit-parallel rows
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        m = masks.get(c, 0)
        u = row & m
        row = ((row + u) | (row - u)) & full
    lcs = len(a) - bin(row).count("1")
    return 200.0 * lcs / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([fuzzy_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def balanced_json(text: str | None) -> str | None:
    """The first balanced {...} or [...] of a reply, strings and escapes respected; null if none closes."""
    for start in (m.start() for m in re.finditer(r"[{\[]", text or "")):
        depth, quoted, i = [], False, start
        while i < len(text):
            c = text[i]
            if quoted:
                if c == "\\":
                    i += 1
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c in "{[":
                depth.append("}" if c == "{" else "]")
            elif c in "}]":
                if not depth or depth.pop() != c:
                    break
                if not depth:
                    return text[start : i + 1]
            i += 1
    return None


@F.pandas_udf(T.StringType())
def balanced_json_udf(x: pd.Series) -> pd.Series:
    return x.map(balanced_json)
