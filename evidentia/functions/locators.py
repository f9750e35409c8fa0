"""Locators: the least word context that makes a quote unique, and what a stored one resolves to."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from evidentia.functions.text import literal

_WORD = re.compile(r"\S+")
LOCATOR = StructType([StructField("exact", StringType()), StructField("prefix", StringType()), StructField("suffix", StringType()), StructField("reason", StringType())])


def starts(text: str, part: str) -> list[int]:
    """Where a part occurs, overlapping occurrences included."""
    out, at = [], text.find(part) if part else -1
    while at >= 0:
        out.append(at)
        at = text.find(part, at + 1)
    return out


def locate(text: str, start: int, end: int) -> dict:
    """The quote with as few whole words as make it unique, one more on each side a step; a word that the quote cuts counts as one.

    Only the places that the words so far allow are looked at again, so a step costs their number.
    """
    if not 0 <= start < end <= len(text):
        return {"exact": None, "prefix": None, "suffix": None, "reason": "out_of_bounds"}
    exact = text[start:end]
    lefts = [m.start() for m in _WORD.finditer(text, 0, start)][::-1]
    rights = (m.end() for m in _WORD.finditer(text, end))
    left, right, rivals, step = start, end, [p for p in starts(text, exact) if p != start], 0
    while rivals:
        left = lefts[step] if step < len(lefts) else 0
        right = next(rights, len(text))
        before, behind, step = text[left:start], text[end:right], step + 1
        rivals = [p for p in rivals if text.endswith(before, 0, p) and text.startswith(behind, p + len(exact))]
    return {"exact": exact, "prefix": text[left:start], "suffix": text[end:right], "reason": None}


@F.pandas_udf(LOCATOR)
def locators(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
    """Locators of spans; one row's text is looked at by one call."""
    return pd.DataFrame([locate(t or "", int(a), int(b)) for t, a, b in zip(text, start, end, strict=True)], columns=["exact", "prefix", "suffix", "reason"])


def resolution(text: Column, prefix: Column, exact: Column, suffix: Column) -> Column:
    """How often the context occurs, as a reason: not_found, ambiguous_occurrence, or null for once."""
    n = F.regexp_count(text, F.concat(F.lit("(?="), literal(F.concat(prefix, exact, suffix)), F.lit(")")))
    return F.when(text.isNull() | (F.length(exact) == 0), "malformed_record").when(n == 0, "not_found").when(n > 1, "ambiguous_occurrence")


def resolved_start(text: Column, prefix: Column, exact: Column, suffix: Column) -> Column:
    """The quote's zero-based start where its context occurs once."""
    whole = F.concat(prefix, exact, suffix)
    return F.when(resolution(text, prefix, exact, suffix).isNull(), F.instr(text, whole) - 1 + F.length(prefix))


_DIFF = ArrayType(StructType([StructField("op", StringType()), StructField("left", StringType()), StructField("right", StringType())]))


@F.pandas_udf(_DIFF)
def token_hunks(left: pd.Series, right: pd.Series) -> pd.Series:
    """Differences of two texts by words, as (op, left, right)."""
    from difflib import SequenceMatcher

    def hunks(a: str, b: str) -> list[dict]:
        x, y = (a or "").split(), (b or "").split()
        return [{"op": op, "left": " ".join(x[i:j]), "right": " ".join(y[k:m])} for op, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if op != "equal"]

    return pd.Series([hunks(a, b) for a, b in zip(left, right, strict=True)])
