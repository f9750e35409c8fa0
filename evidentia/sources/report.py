"""HTML reports of small result tables, for local reading or for export."""

from __future__ import annotations

import html
from collections.abc import Iterable

from pyspark.sql import DataFrame

from evidentia.sources.stores import write_once

MOST_ROWS = 5000


def rows_of(df: DataFrame, order: list[str]) -> list[dict]:
    """A result table's rows for the driver; more than MOST_ROWS are refused, for a report is for reading."""
    rows = [r.asDict() for r in df.orderBy(*order).limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report shows at most {MOST_ROWS} rows")
    return rows


def table_html(rows: list[dict], columns: Iterable[str]) -> str:
    columns = list(columns)
    cell = lambda x: "" if x is None else html.escape(str(x))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(r[c])}</td>" for c in columns) + "</tr>" for r in rows) + "</table>"


def evidence_html(text: str, start: int, end: int, context: int = 200) -> str:
    """Three exact slices of the text around a span, escaped, with the span marked."""
    if not 0 <= start < end <= len(text):
        raise ValueError("the span leaves the text")
    a, b = max(0, start - context), min(len(text), end + context)
    return f"{html.escape(text[a:start])}<mark>{html.escape(text[start:end])}</mark>{html.escape(text[end:b])}"


def report(title: str, sections: dict[str, list[dict]], evidence: list[dict], audience: str) -> str:
    """One page; for export only evidence whose rights allow it keeps its text, others show that it is held back."""
    if audience not in ("local", "export"):
        raise ValueError("the audience is local or export")
    parts = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, rows in sections.items():
        parts.append(f"<h2>{html.escape(name)}</h2>" + (table_html(rows, rows[0]) if rows else "<p>no rows</p>"))
    parts.append("<h2>Evidence</h2>")
    for e in evidence:
        shown = audience == "local" or e.get("rights_status") == "allowed"
        body = evidence_html(e["text"], e["start"], e["end"]) if shown else "<i>text held back</i>"
        parts.append(f"<p id='{html.escape(str(e['evidence_id']))}'>{body}</p>")
    return "\n".join(parts)


def write_report(df_sections: dict[str, tuple[DataFrame, list[str]]], evidence: list[dict], title: str, audience: str, path: str) -> bool:
    """Write a report once; the same report again changes nothing."""
    sections = {n: rows_of(df, order) for n, (df, order) in df_sections.items()}
    spark = next(iter(df_sections.values()))[0].sparkSession
    return write_once(spark, path, report(title, sections, evidence, audience))


def markdown(rows: list[dict], columns: Iterable[str]) -> str:
    """A table as Markdown, with the signs that would break it escaped."""
    columns = list(columns)
    clean = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    return "\n".join([f"| {' | '.join(columns)} |", f"| {' | '.join('---' for _ in columns)} |", *[f"| {' | '.join(clean(r[c]) for c in columns)} |" for r in rows]]) + "\n"
