"""The hand matrix of coverage states and the figures that follow from it."""

from __future__ import annotations

from datetime import date

import pytest

from evidentia.operators import prevalence as P

Q1, Q2 = date(2025, 3, 31), date(2025, 6, 30)
COVERAGE = "event_id string, entity_id string, period_end date, doc_type string, speaker_role string, eligibility_status string, available boolean, parsed boolean, observable boolean, missing_reasons array<string>"
OBSERVATIONS = "event_id string, doc_type string, speaker_role string, theme_id string, headline_eligible boolean, mask_ids array<string>"


def row(event, observable, reasons=(), doc_type="release"):
    entity, quarter = event.split("-")
    return (event, entity, {"Q1": Q1, "Q2": Q2}[quarter], doc_type, "all", "eligible", observable or "unavailable" not in reasons, observable, observable, list(reasons))


@pytest.fixture(scope="module")
def matrix(spark):
    states = [("A-Q1", True, []), ("A-Q2", True, ["explicit_no_theme"]), ("B-Q1", True, []), ("B-Q2", False, ["not_found"]), ("C-Q1", False, ["calibration_required"]), ("D-Q1", False, ["parse_failed"]),
              ("E-Q1", False, ["rights_restricted"]), ("F-Q1", False, ["valid_unmatched"]), ("G-Q1", False, ["no_theme_unconfirmed"]), ("H-Q1", False, ["assessment_flagged", "assessment_refused"])]
    rows = [row(*s) for s in states] + [row(s[0], False, ["transcript_not_in_scope"], "transcript") for s in states]
    coverage = spark.createDataFrame(rows, COVERAGE)
    tree = spark.createDataFrame([("capacity", None), ("capacity_expansion", "capacity"), ("demand", None)], "theme_id string, parent_id string")
    families = spark.createDataFrame([("operations", "capacity"), ("operations", "capacity_expansion"), ("expansion", "capacity_expansion")], "family_id string, theme_id string")
    seen = [("A-Q1", "release", "all", "capacity_expansion", True, []), ("A-Q1", "release", "all", "capacity_expansion", True, []), ("B-Q1", "release", "all", "capacity", True, ["m1"])]
    return coverage, spark.createDataFrame(seen, OBSERVATIONS), P.views_of(tree, families), seen


def figures(coverage, observations, views):
    out = {}
    for r in P.prevalence(coverage, observations, views).collect():
        out[r["doc_type"], r["view_kind"], r["view_id"], r["unit"], r["period_end"]] = r
    return out


def test_parent_view(matrix):
    f = figures(*matrix[:3])
    got = {(u, p): (f["release", "parent", "capacity", u, p]["numerator"], f["release", "parent", "capacity", u, p]["denominator"]) for u, p in (("issuer_period", Q1), ("issuer_period", Q2), ("issuer_window", None), ("firm_quarter", None), ("equal_issuer_mean", None))}
    assert got == {("issuer_period", Q1): (1, 2), ("issuer_period", Q2): (0, 1), ("issuer_window", None): (1, 2), ("firm_quarter", None): (1, 3), ("equal_issuer_mean", None): (0.5, 2)}
    assert f["release", "parent", "capacity", "equal_issuer_mean", None]["rate"] == 0.25


def test_families_and_empty_denominators(matrix):
    f = figures(*matrix[:3])
    assert [f["release", "family", v, "issuer_period", Q1]["rate"] for v in ("operations", "expansion")] == [0.5, 0.5]
    t = f["transcript", "direct", "demand", "firm_quarter", None]
    assert (t["denominator"], t["rate"], t["reason"]) == (0, None, "empty_denominator")
    assert len({(k[1], k[2]) for k in f}) == 6


def test_duplicates_add_no_votes(spark, matrix):
    coverage, _, views, seen = matrix
    more = spark.createDataFrame(seen + seen[:1] * 20 + [("A-Q1", "release", "all", "capacity", True, [])], OBSERVATIONS).repartition(7)
    a, b = figures(*matrix[:3]), figures(coverage.repartition(5), more, views)
    assert {k: v["numerator"] for k, v in a.items() if k[1] == "parent"} == {k: v["numerator"] for k, v in b.items() if k[1] == "parent"}


def test_bad_trees(spark):
    with pytest.raises(ValueError, match="not in the tree"):
        P.closure(spark.createDataFrame([("a", "x")], "theme_id string, parent_id string"))
    with pytest.raises(ValueError, match="cycle"):
        P.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "theme_id string, parent_id string"))
