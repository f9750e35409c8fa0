"""Cases for the fixed rules: boilerplate, sentences, names, locators, decoding, heads, intervals of statistics."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions import locators as K, stats as S, text as T
from evidentia.functions.sentences import sentence_spans
from evidentia.operators import layout as L
from evidentia.sources.html import decode_html_bytes, walk


def test_boilerplate_phrases(spark):
    cases = {
        "As the Private Securities Litigation Reform Act says": "safe_harbor",
        "Forward-looking statements carry uncertainties.": "safe_harbor",
        "Forward-looking statements alone.": None,
        "Non-GAAP figures are no substitute for others.": "non_gaap_disclaimer",
        "Non-GAAP figures should not be considered in isolation.": "non_gaap_disclaimer",
        "Non-GAAP figures have limitations.": None,
        "X is a registered trademark.": "repeated_legal",
        "All names are trademarks of their owners.": "repeated_legal",
        "We grant a license to all.": None,
        "This shall not be deemed to be filed.": "repeated_legal",
        "Shall not be deemed an error.": None,
        "This does not constitute an offer.": "repeated_legal",
        "Where To Find It": "repeated_legal",
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", T.boilerplate(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in rows} == cases


def test_masks_follow_headings(spark):
    blocks = [
        ("heading", "Safe Harbor"), ("paragraph", "One"), ("page_artifact", "3"), ("list_item", "Two"), ("table", "x"), ("paragraph", "Three"), ("heading", "Non-GAAP Measures"), ("footnote", "Four"),
        ("heading", "Results"), ("paragraph", "Five"), ("paragraph", "Names are trademarks of others."), ("sentence", "It is a registered trademark."),
    ]
    rows = spark.createDataFrame([("d", i, *b) for i, b in enumerate(blocks)] + [("e", 0, "paragraph", "Of another document")], "doc_id string, position int, type string, text string")
    got = sorted((r["position"], r["category"]) for r in L.boilerplate_masks(rows).collect())
    assert got == [(0, "safe_harbor"), (1, "safe_harbor"), (3, "safe_harbor"), (6, "non_gaap_disclaimer"), (7, "non_gaap_disclaimer"), (10, "repeated_legal")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("One. Two.", ["One.", "Two."]),
        ("Up 5 percent. then down.", ["Up 5 percent. then down."]),
        ("He said \"Yes.\" Then left.", ["He said \"Yes.\"", "Then left."]),
        ("Acme Inc. Reports. Next", ["Acme Inc. Reports.", "Next"]),
        ("It was INC. Next", ["It was INC.", "Next"]),
        ("By J.P. Morgan. Next", ["By J.P. Morgan.", "Next"]),
        ("At 5 p.m. Eastern. Next", ["At 5 p.m. Eastern.", "Next"]),
        ("1. First. 2. Second", ["1. First.", "2.", "Second"]),
        ("iv. First item. b. Second", ["iv. First item. b.", "Second"]),
        ("iv. First item. B. Second", ["iv. First item.", "B. Second"]),
        ("a) First. Second", ["a) First.", "Second"]),
        ("• Point one. Point two", ["Point one.", "Point two"]),
        ("(1) Note. More", ["Note.", "More"]),
        ("*** Note", ["Note"]),
        ("•", []),
        ("(1) ", []),
        ("", []),
        ("Really?! Yes! [Sic] (No. 5)", ["Really?!", "Yes!", "[Sic] (No. 5)"]),
        ("Is it est. Yes. No. 5 it is", ["Is it est. Yes.", "No. 5 it is"]),
        ("Best. Yes", ["Best.", "Yes"]),
    ],
)
def test_sentence_rules(text, want):
    assert [text[a:b] for a, b in sentence_spans(text)] == want


def test_names(spark):
    tokens = lambda x: set(spark.range(1).select(T.name_tokens(F.lit(x))).first()[0])
    cover = lambda cited, other: spark.range(1).select(T.covers(T.name_tokens(F.lit(other)), T.significant(T.name_tokens(F.lit(cited))))).first()[0]
    assert tokens("Macy's & Söhne (old) Inc.") == {"macys", "and", "sohne", "inc"}
    assert cover("Johnson & Johnson", "Johnson Johnson Holdings") and cover("The Kroger Co.", "KROGER COMPANY") and not cover("The Co.", "The Company")
    assert cover("Class One Stock", "Stock Class One") and not cover("Class One Stock", "One")


def test_locators_grow_on_both_sides():
    text = "a b c d a b c e a b x"
    for start, end in ((0, 1), (8, 9), (16, 17), (2, 3), (18, 19), (1, 2), (0, 21), (7, 10)):
        got = K.locate(text, start, end)
        whole = got["prefix"] + got["exact"] + got["suffix"]
        assert K.starts(text, whole) == [start - len(got["prefix"])]
    assert K.locate(text, 8, 9) == {"exact": "a", "prefix": "d ", "suffix": " b", "reason": None}
    assert K.locate("one two three two one", 14, 17)["prefix"] == "three " and K.locate("one two three two one", 14, 17)["suffix"] == " one"
    rng, long = random.Random(1), " ".join(random.Random(2).choice("ab") for _ in range(4000))
    for _ in range(5):
        at = rng.randrange(0, 7000, 2)
        got = K.locate(long, at, at + 1)
        assert long[at - len(got["prefix"]) : at] == got["prefix"] and len(K.starts(long, got["prefix"] + got["exact"] + got["suffix"])) == 1


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (b"\xef\xbb\xbf<p>x", ("<p>x", "UTF-8", "bom")),
        ("x".encode("utf-16"), ("x", "UTF-16LE", "bom")),
        ("<meta charset=utf-16>é".encode(), ("<meta charset=utf-16>é", "UTF-8", "meta")),
        (b"<meta charset='iso_8859-1'>\x93\x81", ("<meta charset='iso_8859-1'>\u201c\x81", "windows-1252", "meta")),
        (b"<meta charset=koi8-r>\xc1", ("<meta charset=koi8-r>а", "koi8-r", "meta")),
        ("<meta charset=nonsense>é".encode(), ("<meta charset=nonsense>é", "UTF-8", "valid-utf-8")),
        (b"\x80\x8d\xe9", ("€\x8dé", "windows-1252", "default")),
        (b" " * 1024 + b"<meta charset=latin1>\xc3\xa9", (" " * 1024 + "<meta charset=latin1>é", "UTF-8", "valid-utf-8")),
    ],
)
def test_decoding(raw, want):
    assert decode_html_bytes(raw) == want


def test_heads_need_no_end():
    blocks = lambda h: [(b["type"], b["text"]) for b in walk(h)]
    assert blocks("<html><head><title>t</title><body><p>Hi there.</p></body></html>") == [("paragraph", "Hi there.")]
    assert blocks("<head><title>t</title><noscript><p>Hi.</p>") == [("paragraph", "Hi.")] and blocks("<head><style>p{}</style></head><h2>A</h2>b") == [("heading", "A"), ("paragraph", "b")]


def test_undefined_resamples(spark):
    sums = spark.createDataFrame([("a", 1, 0), ("b", 0, 0), ("c", 0, 0)], "cluster string, tp long, fp long")
    drawn, share = S.draws(spark, ["a", "b", "c"], 3, 200), S.ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    whole = S.bootstrap(sums, drawn, share, most_undefined=0.9).first()
    assert whole["n_defined"] + whole["n_undefined"] == 200 and 20 < whole["n_undefined"] < 110 and (whole["low"], whole["high"], whole["point"]) == (1.0, 1.0, 1.0)
    strict = S.bootstrap(sums, drawn, share, most_undefined=0.05).first()
    assert (strict["low"], strict["high"], strict["point"]) == (None, None, 1.0)


def test_judge_agreement(spark):
    rng = random.Random(4)
    rows = [(f"e{i % 7}", rng.choice([0, 1, None]), rng.randint(0, 1), rng.random() < 0.3) for i in range(120)] + [("lost", None, 1, True)]
    got = {r["measure"]: r for r in S.judge_agreement(spark.createDataFrame(rows, "event_id string, label int, verdict int, uncertain boolean"), 5, 80).collect()}
    known = [r for r in rows if r[1] is not None]
    events = sorted({r[0] for r in known})

    def measures(pairs):
        n = len(pairs)
        same, a, b = sum(x == y for x, y in pairs) / n, sum(x for x, _ in pairs) / n, sum(y for _, y in pairs) / n
        by_chance, mean = a * b + (1 - a) * (1 - b), (a + b) / 2
        return {"kappa": (same - by_chance) / (1 - by_chance), "ac1": (same - 2 * mean * (1 - mean)) / (1 - 2 * mean * (1 - mean))}

    point, draw, values = measures([(r[2], r[1]) for r in known]), random.Random(5), {"kappa": [], "ac1": []}
    for _ in range(80):
        drawn = [events[draw.randrange(len(events))] for _ in events]
        for k, v in measures([(r[2], r[1]) for e in drawn for r in known if r[0] == e]).items():
            values[k].append(v)
    for k, v in values.items():
        v.sort()
        at = 0.05 * 79
        assert got[k]["point"] == pytest.approx(point[k]) and got[k]["low"] == pytest.approx(v[3] + (v[4] - v[3]) * (at - 3))
        assert (got[k]["n_labels"], got[k]["n_uncertain"], got[k]["n_defined"]) == (len(known), sum(r[3] for r in known), 80)
