"""Prompt keys, word error rates and edit distances over id sequences."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")


@F.pandas_udf(T.StringType())
def canonical_prompt(text: pd.Series) -> pd.Series:
    """NFKC, case folding, single spaces; null stays null."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def edit_distance(a, b) -> int:
    """Levenshtein distance of two sequences, a column of the table at a time as bits of whole numbers (Myers, Hyyrö)."""
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a)
    n, at = len(a), {}
    wanted = set(b)
    for i, x in enumerate(a):
        if x in wanted:
            at.setdefault(x, bytearray(n // 8 + 1))[i >> 3] |= 1 << (i & 7)
    at = {x: int.from_bytes(m, "little") for x, m in at.items()}
    every = (1 << n) - 1
    more, less, score = every, 0, n
    for y in b:
        same = at.get(y, 0)
        diagonal = (((same & more) + more) ^ more) | same
        up, down = less | (every & ~(diagonal | more)), more & diagonal
        score += (up >> (n - 1) & 1) - (down >> (n - 1) & 1)
        up, down = (up << 1 | 1) & every, down << 1 & every
        vertical = same | less
        more, less = down | (every & ~(vertical | up)), up & vertical
    return score


@F.pandas_udf(T.IntegerType())
def sequence_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Levenshtein distance of id arrays; null if either is null."""
    return pd.Series([None if x is None or y is None else edit_distance(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(T.StructType([T.StructField("edits", T.IntegerType()), T.StructField("words", T.IntegerType())]))
def word_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """Word edits and reference words of case-folded texts."""
    rows = []
    for r, h in zip(reference, hypothesis, strict=True):
        a, b = WORD.findall((r or "").casefold()), WORD.findall((h or "").casefold())
        rows.append((edit_distance(a, b), len(a)))
    return pd.DataFrame(rows, columns=["edits", "words"]).astype("int32")


def word_error_rate(edits: Column) -> Column:
    """Edits over reference words; an empty reference gives 0 without edits, else 1."""
    return F.when(edits["words"] == 0, F.when(edits["edits"] == 0, 0.0).otherwise(1.0)).otherwise(F.try_divide(edits["edits"], edits["words"]))


def redact_secrets(text: Column) -> Column:
    """Bearer tokens and key-like strings replaced."""
    return F.regexp_replace(F.regexp_replace(text, r"(?i)bearer\s+[\w.\-]+", "Bearer [redacted]"), r"\bsk-[\w\-]{8,}", "[redacted]")


def pattern_name(index: int) -> str:
    """0 is A, 25 Z, 26 AA."""
    out = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out
