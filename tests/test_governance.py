"""Governance, filings, extraction and report operators on small rows."""

from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from evidentia.functions import locators as K
from evidentia.operators import extraction as X, governance as G, identity as N, release as R
from evidentia.sources import columns as J, report as H


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_rights(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "doc_id string, text string")
    rights = spark.createDataFrame([("a", True), ("b", False)], "doc_id string, retain_text boolean")
    assert values(G.with_rights(rows, rights, ["text"]), "doc_id", "text") == [("a", "x"), ("b", None), ("c", None)]


def test_targets(spark):
    targets = spark.createDataFrame([("t1", "d", "c1", "x"), ("t2", "d", "c9", "x"), ("t3", "d", "c1", "zz"), ("t4", "d", "c2", "x"), ("t5", "d", "c3", "x")], "target_id string, doc_id string, claim_id string, theme_id string")
    claims = spark.createDataFrame([("d", "c1", ["q1"]), ("d", "c2", ["q9"]), ("d", "c3", ["q2"])], "doc_id string, claim_id string, quote_ids array<string>")
    quotes = spark.createDataFrame([("d", "q1", None), ("d", "q2", "text_mismatch")], "doc_id string, quote_id string, reason string")
    themes = spark.createDataFrame([("x", "X")], "theme_id string, label string")
    assert values(G.resolved_targets(targets, claims, quotes, themes), "target_id", "refusal") == [("t1", None), ("t2", "unknown_claim"), ("t3", "unknown_theme"), ("t4", "unknown_quote"), ("t5", "quote_not_verified")]


def test_labels(spark):
    a = spark.createDataFrame([("t1", 1), ("t2", 0)], "target_id string, label int")
    b = spark.createDataFrame([("t2", 0), ("t3", 1)], "target_id string, label int")
    assert values(G.merged_labels(a, b), "target_id", "label") == [("t1", 1), ("t2", 0), ("t3", 1)]
    with pytest.raises(Exception, match="committed label differs"):
        G.merged_labels(a, spark.createDataFrame([("t2", 1)], "target_id string, label int")).collect()


def test_overrides(spark):
    events = spark.createDataFrame([("e1", "d1", "a1"), ("e2", "d2", "a2")], "event_id string, digest string, release_accession string")
    overrides = spark.createDataFrame([("e1", "d1", "o1", "b1"), ("e2", "old", "o2", "b2"), ("e9", "d", "o3", "b3")], "event_id string, digest string, override_id string, release_accession string")
    applied, left = G.event_overrides(events, overrides)
    assert values(applied, "event_id", "release_accession", "applied_override") == [("e1", "b1", "o1"), ("e2", "a2", None)]
    assert values(left, "override_id", "status") == [("o2", "stale"), ("o3", "unknown_event")]


def test_append_transitions(spark, tmp_path):
    schema = "document_id string, run_id string, sequence long, recorded_at timestamp, from_state string, to_state string, missing_reason string, failure_reason string, override_id string"
    log, at = str(tmp_path / "log"), datetime(2024, 1, 1)
    G.append_transitions(spark.createDataFrame([("d", "r1", 1, at, None, "expected", "waiting", None, None)], schema), log)
    with pytest.raises(FileExistsError):
        G.append_transitions(spark.createDataFrame([("d", "r1", 1, at, None, "expected", "waiting", None, None)], schema), log)
    later = datetime(2024, 1, 2)
    with pytest.raises(ValueError, match="history breaks"):
        G.append_transitions(spark.createDataFrame([("d", "r2", 1, later, None, "expected", "waiting", None, None)], schema), log)
    G.append_transitions(spark.createDataFrame([("d", "r2", 1, later, "expected", "acquired", None, None, None)], schema), log)


def test_evidence(spark):
    cells = spark.createDataFrame([("t", ["a", "b"], ["b"]), ("t", ["c"], ["d"]), ("u", [], [])], "theme string, accepted array<string>, gold array<string>")
    got = {r["theme"]: r for r in G.evidence_tallies(cells, ["theme"]).collect()}
    assert (got["t"]["hit"], got["t"]["jaccard"], got["t"]["recall"]) == (1, 0.25, 0.5) and got["u"]["f1"] is None and got["u"]["precision"] is None
    assert spark.range(1).select(G.joint_label(F.lit(1), F.lit(None))).first()[0] is None


def test_coding_problems(spark):
    c = spark.createDataFrame([("k", "completed")], "classification_id string, status string")
    p = spark.createDataFrame([("p1", "k", "d", "c", "t"), ("p2", "x", "d", "c", "u")], "proposal_id string, classification_id string, doc_id string, claim_id string, theme_id string")
    d = spark.createDataFrame([("d1", "d", "c", "t", "accepted", ["q"]), ("d2", "d", "c", "w", "rejected", [])], "decision_id string, doc_id string, claim_id string, theme_id string, status string, supporting_quote_ids array<string>")
    a = spark.createDataFrame([("a1", "d", "t", "q"), ("a2", "d", "t", "z")], "assignment_id string, doc_id string, theme_id string, quote_id string")
    assert values(G.coding_problems(c, p, d, a), "id", "problem") == [("a2", "assignment_without_decision"), ("d2", "decision_without_proposal"), ("p2", "proposal_without_classification"), ("p2", "proposal_without_decision")]


def test_locators(spark):
    text = "one two three two one"
    assert K.locate(text, 4, 7) == {"exact": "two", "prefix": "one ", "suffix": " three", "reason": None}
    assert K.locate("a a", 0, 9)["reason"] == "out_of_bounds" and K.locate("aa b", 0, 1)["suffix"] == "a"
    row = spark.createDataFrame([(text,)], "t string").select(K.resolved_start(F.col("t"), F.lit("one "), F.lit("two"), F.lit("")).alias("at"), K.resolution(F.col("t"), F.lit(""), F.lit("two"), F.lit("")).alias("r"), K.token_hunks("t", F.lit("one 2 three two one")).alias("d")).first()
    assert row["at"] == 4 and row["r"] == "ambiguous_occurrence" and [(h["op"], h["left"], h["right"]) for h in row["d"]] == [("replace", "two", "2")]


def test_release(spark):
    rows = spark.createDataFrame([("Results for the quarter ended June 30, 2025.",), ("Results for the quarter ended March 31, 2025.",), ("Preliminary results",), ("Results",)], "t string")
    assert [r[0] for r in rows.select(R.candidate_drop(F.col("t"), F.lit("2025-06-30").cast("date"), F.lit("Q2"))).collect()] == [None, "states_other_period", "preliminary", None]
    f = spark.createDataFrame([("a", "Cover\nItem 2.02. Results\nWe report.\nItem 9.01 Exhibits\nExhibit 99.1")], "accession string, text string")
    assert values(R.item_sections(f), "item", "body") == [("2.02", "Results\nWe report."), ("9.01", "Exhibits\nExhibit 99.1")]
    assert values(R.named_exhibits(f), "exhibit") == [("99.1",)]


def test_identity(spark):
    left = spark.createDataFrame([(1, ["alpha", "beta"]), (2, ["beta"])], "id long, tokens array<string>")
    right = spark.createDataFrame([("x", ["beta"]), ("y", ["alpha", "beta"]), ("z", [])], "rid string, tokens array<string>")
    pairs = N.token_candidates(left, right, "id", "rid")
    assert values(pairs, "id", "rid") == [(1, "x"), (1, "y"), (2, "x")]
    assert values(N.matched_once(pairs, "id", "rid"), "id", "rid", "reason") == [(1, None, "several"), (2, "x", None)]


def test_refusals(spark):
    rows = spark.createDataFrame([(1, "c", ["U1"]), (2, " ", ["U1"]), (3, "c", []), (4, "c", ["U9"]), (5, "c", ["U1", "U1"]), (6, "x" * 700, ["U1"])], "n int, claim string, cited array<string>").withColumn("known", F.create_map(F.lit("U1"), F.lit("e1")))
    assert values(X.refusals(rows), "n", "reason", "element_ids") == [(1, None, ["e1"]), (2, "blank_claim", None), (3, "no_label", None), (4, "unknown_label", None), (5, "duplicate_label", None), (6, "claim_too_long", None)]


def test_reports(spark, tmp_path):
    evidence = [{"evidence_id": "e1", "text": "a <b> c", "start": 2, "end": 5, "rights_status": "allowed"}, {"evidence_id": "e2", "text": "secret", "start": 0, "end": 3, "rights_status": "restricted"}]
    page = H.report("T & U", {"rows": [{"a": "<x>", "b": None}]}, evidence, "export")
    assert "a <mark>&lt;b&gt;</mark> c" in page and "secret" not in page and "&lt;x&gt;" in page and "T &amp; U" in page
    df = spark.createDataFrame([(1, "x|y")], "a int, b string")
    assert H.write_report({"s": (df, ["a"])}, [], "R", "local", str(tmp_path / "r.html")) and not H.write_report({"s": (df, ["a"])}, [], "R", "local", str(tmp_path / "r.html"))
    assert H.markdown([{"a": "x|y"}], ["a"]).splitlines()[-1] == "| x\\|y |"


def test_registrants(spark):
    payload = json.dumps({"cik": "0000000007", "name": "New", "tickers": ["N"], "formerNames": [{"name": "Old", "from": "2001-01-01T00:00:00.000Z", "to": "2005-01-01T00:00:00.000Z"}], "filings": {"files": [{"name": "p1", "filingCount": 3, "filingFrom": "2000-01-01", "filingTo": "2004-01-01"}]}})
    names, pages = J.registrants(spark.createDataFrame([(payload,)], "p string"), "p")
    assert values(names, "cik", "name", "valid_to") == [(7, "New", None), (7, "Old", date(2005, 1, 1))] and values(pages, "page", "stated_count") == [("p1", 3)]
    late = spark.createDataFrame([(7, "p1", date(2000, 1, 1), date(2004, 1, 5)), (7, "p2", date(2004, 1, 1), date(2006, 1, 1))], "cik long, page string, first_on date, last_on date")
    assert values(G.page_shifts(late), "page") == [("p1",)]
