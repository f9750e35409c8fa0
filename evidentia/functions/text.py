"""Text rules as column expressions; only Unicode normalisation needs Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: White space as str.split() has it. (Fixed values.)
SPACE_CLASS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Characters that normalisation deletes. (Fixed values.)
DELETED_CLASS = r"[\x{AD}\x{200B}\x{2060}\x{FEFF}\x{00}-\x{08}\x{0E}-\x{1B}\x{7F}-\x{84}\x{86}-\x{9F}]"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def _ascii_folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def normalized(text: Column) -> Column:
    """NFC, invisible and control characters deleted, white space made single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_nfc(text), DELETED_CLASS, ""), SPACE_CLASS + "+", " "))


def contains_all(text: Column, *phrases: str) -> Column:
    out = F.lit(True)
    for p in phrases:
        out = out & text.contains(p)
    return out


def contains_any(text: Column, *phrases: str) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


#: Headings of safe-harbor sections. (Fixed values.)
SAFE_HARBOR_HEADINGS = ["forward-looking statements", "forward-looking information", "safe harbor", "cautionary statement", "cautionary note"]
#: Phrases of the boilerplate classes. (Fixed values.)
LITIGATION = ["private securities litigation reform act"]
FORWARD, FORWARD_WITH = "forward-looking statements", ["risks", "uncertainties", "undue reliance", "actual results"]
NON_GAAP, NON_GAAP_WITH = "non-gaap", ["in accordance with", "substitute for", "in isolation", "not be considered"]
TRADEMARK = ["registered trademark", "trademarks of"]
FILED, FILED_WITH = "shall not be deemed", "filed"
SOLICITATION = ["does not constitute an offer", "where to find it", "participants in the solicitation"]


def heading_boilerplate(text: Column) -> Column:
    """The class that a heading opens, null for none."""
    t = F.lower(text)
    return F.when(contains_any(t, *SAFE_HARBOR_HEADINGS), "safe_harbor").when(t.contains(NON_GAAP), "non_gaap_disclaimer")


def boilerplate(text: Column) -> Column:
    """The first class whose phrases a block has, null for none."""
    t = F.lower(text)
    return (
        F.when(contains_any(t, *LITIGATION) | (t.contains(FORWARD) & contains_any(t, *FORWARD_WITH)), "safe_harbor")
        .when(t.contains(NON_GAAP) & contains_any(t, *NON_GAAP_WITH), "non_gaap_disclaimer")
        .when(contains_any(t, *TRADEMARK) | contains_all(t, FILED, FILED_WITH) | contains_any(t, *SOLICITATION), "repeated_legal")
    )


def line_class(line: Column) -> Column:
    """What a line is by its pattern: rule, dot_leader, page_number, page_of, numeric or null; a bare year is none."""
    t = F.trim(line)
    return (
        F.when(t.rlike(r"^[-_=*—]{3,}$"), "rule").when(t.rlike(r"\.{4,}\s*\S*$"), "dot_leader")
        .when(t.rlike(r"^(?:19|20)[0-9]{2}$"), None).when(t.rlike(r"^-?\s*[0-9]{1,4}\s*-?$"), "page_number")
        .when(t.rlike(r"(?i)^(?:page\s+)?[0-9]+\s+of\s+[0-9]+$"), "page_of").when(t.rlike(r"^[$(]*[0-9][0-9,.]*[)%]*$"), "numeric")
    )


def literal(x: Column) -> Column:
    """A pattern that matches the text itself."""
    return F.concat(F.lit(r"\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def occurrences(text: Column, needle: Column | str) -> Column:
    """Zero-based starts of every occurrence, overlapping ones included; none for an empty needle.

    The text is split before each occurrence, so the work is linear in its length.
    """
    x = F.lit(needle) if isinstance(needle, str) else needle
    parts = F.transform(F.split(text, F.concat(F.lit("(?=") , literal(x), F.lit(")")), -1), F.length)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    ends = F.aggregate(parts, begin, lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["starts"], a["at"] + n).alias("starts")), lambda a: a["starts"])
    inner = F.slice(ends, F.lit(1), F.size(ends) - 1)  # the last end is the text's
    found = F.when(text.startswith(x), F.array_union(F.array(F.lit(0)), inner)).otherwise(inner)
    return F.when((F.length(x) > 0) & text.contains(x), found).otherwise(F.array().cast("array<int>"))


def char_windows(text: Column, width: int) -> Column:
    """Every run of `width` characters, by an empty match that looks ahead at each place."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{width}}}))"), 1)


MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def dates_masked(text: Column) -> Column:
    """Full dates with a month's name replaced by NUL."""
    return F.regexp_replace(text, rf"\b(?:{MONTHS})\s+[0-9]{{1,2}},\s+[0-9]{{4}}\b", "\u0000")


def stated_dates(text: Column) -> Column:
    """Dates that follow "ended" or "ending"."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i)\bend(?:ed|ing)\s+((?:{MONTHS})\s+[0-9]{{1,2}},\s+[0-9]{{4}})"), 1)
    return F.array_compact(F.transform(found, lambda d: F.try_to_date(F.initcap(d), "MMMM d, yyyy")))


#: Ordinals of fiscal periods. (Fixed values.)
_ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4}


def stated_periods(text: Column) -> Column:
    """Fiscal quarters that a text states, as Q1..Q4 and FY, in sorted order without repeats."""
    t = F.lower(text)
    found = [F.when(t.rlike(rf"\b{word}[\s-]+(?:fiscal[\s-]+)?quarter\b|\bq{n}\b|\b{n}q\b"), f"Q{n}") for word, n in _ORDINALS.items()]
    return F.array_sort(F.array_compact(F.array(*found, F.when(t.rlike(r"\b(?:full|fiscal)[\s-]+year\b"), "FY"))))


def period_matches(stated: Column, label: Column) -> Column:
    """Whether the stated periods hold the label's; a full year and a fourth quarter stand for each other, none is unjudged."""
    wanted = F.when(label == "FY", F.array(F.lit("Q4"), F.lit("FY"))).when(label == "Q4", F.array(F.lit("Q4"), F.lit("FY"))).otherwise(F.array(label))
    return F.when(label.isNull() | (F.size(stated) == 0), None).otherwise(F.arrays_overlap(stated, wanted))


def announces_results(text: Column) -> Column:
    """Whether an opening text announces results."""
    return F.lower(text).rlike(r"\b(?:reports?|announces?|reported|announced)\b[^.]{0,120}\b(?:results|earnings)\b")


def exhibit_numbers(text: Column) -> Column:
    """Numbers of the exhibits that a text names, 99.01 and 99.1 as one."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\bexhibits?\s+([0-9]+\.[0-9]+)"), 1)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\.0+([0-9])", ".$1")))


#: Legal forms and connectives that say nothing about who a name is. (Fixed values.)
LEGAL_FORMS = ["and", "co", "companies", "company", "corp", "corporation", "inc", "incorporated", "limited", "llc", "ltd", "plc", "the"]


def name_tokens(name: Column, fold: bool = True) -> Column:
    """Lower-case words of a name without parentheses and apostrophes; & counts as and."""
    plain = _ascii_folded(name) if fold else name
    clean = F.replace(F.regexp_replace(F.lower(plain), r"\([^)]*\)", " "), F.lit("'"), F.lit(""))
    return F.array_distinct(F.regexp_extract_all(F.replace(clean, F.lit("&"), F.lit(" and ")), F.lit(r"([a-z0-9]+)"), 1))


def significant(tokens: Column) -> Column:
    """The words of a name that another one must have to cover it."""
    return F.array_except(tokens, F.array(*[F.lit(x) for x in LEGAL_FORMS]))


def covers(tokens: Column, wanted: Column) -> Column:
    """Whether all wanted (significant) tokens are there; nothing wanted covers nothing."""
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, tokens)) == 0)


def escaped(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def marked(text: Column, start: Column, end: Column) -> Column:
    """HTML of a text with one span marked."""
    return F.concat(escaped(F.substring(text, F.lit(1), start)), F.lit("<mark>"), escaped(F.substring(text, start + 1, end - start)), F.lit("</mark>"), escaped(F.substring(text, end + 1, F.length(text))))


def fragment_url(url: Column, quote: Column) -> Column:
    """A link to the quote by its text fragment; another fragment is replaced."""
    return F.concat(F.regexp_replace(url, "#.*$", ""), F.lit("#:~:text="), F.replace(F.url_encode(quote), F.lit("+"), F.lit("%20")))


def paragraphs(markdown: Column) -> Column:
    """Blocks of a Markdown text between blank lines."""
    return F.filter(F.transform(F.split(markdown, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")


def scale_phrases(text: Column) -> Column:
    """How often amounts in thousands, millions or billions are named."""
    return F.regexp_count(F.lower(text), F.lit(r"\b(?:thousand|million|billion)s?\b"))


def signed_figures(text: Column) -> Column:
    """Figures with their sign; parentheses make a figure negative."""
    found = F.regexp_extract_all(text, F.lit(r"(\([$]?[0-9][0-9,]*(?:\.[0-9]+)?\)|-?[$]?[0-9][0-9,]*(?:\.[0-9]+)?)"), 1)
    return F.transform(found, lambda x: F.concat(F.when(x.startswith("(") | x.startswith("-"), "-").otherwise(""), F.regexp_replace(x, r"[^0-9.]", "")))
