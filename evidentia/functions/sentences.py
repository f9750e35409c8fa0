"""Sentence spans as an Arrow function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Abbreviations whose full stop ends no sentence, as they are written. (Fixed values.)
ABBREVIATIONS = (
    "Mr. Mrs. Ms. Dr. Prof. Sr. Jr. St. Inc. Corp. Co. Cos. Ltd. Bros. L.P. L.L.C. N.A. N.V. S.A. P.C. U.S. U.K. U.N. E.U. N.Y. D.C. "
    "Jan. Feb. Mar. Apr. Jun. Jul. Aug. Sep. Sept. Oct. Nov. Dec. No. Nos. vs. v. approx. est. e.g. i.e. etc. a.m. p.m. Fig. Vol. Ph.D. Ave. Blvd."
).split()
#: Bullets and footnote marks that may lead a block. (Fixed values.)
BULLETS, FOOTNOTE_MARK = "•●◦▪■‣⁃·∙", r"\(\d{1,2}\)|\([a-z]\)|\*{1,3}|[†‡]|[¹²³⁰-⁹]+"
_LEAD = re.compile(rf"(?:[{BULLETS}]|{FOOTNOTE_MARK})\s*")
#: Terminals with closing marks, and the first character behind the space that follows; what may begin a sentence.
_TERMINAL = re.compile(r"([.!?])[\"')\]”’]*(?=\s+(\S))")
_BEGINS = re.compile(r"[0-9\"'(\[“‘]")
#: Behind these a full stop at the end of what is looked at ends no sentence: an abbreviation or an initial.
_STAYS = re.compile(rf"(?:(?<![^\W_])(?:{'|'.join(map(re.escape, ABBREVIATIONS))})|(?<![^\W\d_])[^\W\d_]\.)$")
_LONGEST = max(map(len, ABBREVIATIONS))
_ENUMERATOR = re.compile(r"(?:\d{1,2}|[a-z]|[ivx]{1,4})\.", re.I)


def _stays(text: str, at: int, stop: int, first: bool) -> bool:
    """Whether the full stop before `stop` is part of an abbreviation, an initial or the block's leading enumerator."""
    found = _STAYS.search(text, max(0, stop - _LONGEST), stop)
    if found and (len(found[0]) > 2 or found[0] in ABBREVIATIONS or found[0][0].isupper()):
        return True
    return first and _ENUMERATOR.fullmatch(text, at, stop) is not None


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Half-open spans of a block's sentences; its text has single spaces.

    A bullet or footnote mark that leads the block is part of no sentence, and a block of nothing
    else has none. A terminal ends a sentence where a capital, a digit or an opening mark follows,
    unless its full stop belongs to an abbreviation, an initial or the leading enumerator.
    """
    lead = _LEAD.match(text)
    begin = at = lead.end() if lead else 0
    spans = []
    for m in _TERMINAL.finditer(text, begin):
        behind = m[2]
        if (behind.isupper() or _BEGINS.match(behind)) and not (m[1] == "." and _stays(text, at, m.start() + 1, at == begin)):
            spans.append((at, m.end()))
            at = m.start(2)
    return [*spans, (at, len(text))] if begin < len(text) else []


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))
def sentences(s: pd.Series) -> pd.Series:
    return s.map(lambda x: [] if not x else [{"start": a, "end": b} for a, b in sentence_spans(x)])
