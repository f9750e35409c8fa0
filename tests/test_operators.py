"""Operators on small hand-made rows, one case per rule."""

from __future__ import annotations

import json
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from evidentia.functions import dates as D, hashing as H, stats as S, text as T
from evidentia.functions.sentences import sentence_spans
from evidentia.operators import contracts as C, intervals as I, layout as L, selection as X, spans as Z, states as ST, support as U
from evidentia.sources import columns as J, html as W, stores as R


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_reconstruct_breaks(spark):
    days = spark.createDataFrame(
        [(1, date(2020, 1, 1), "added"), (1, date(2020, 2, 1), "removed"), (1, date(2020, 3, 1), "added"), (2, date(2020, 1, 1), "removed"), (3, date(2020, 1, 1), "ambiguous"), (4, date(2020, 1, 1), "added"), (4, date(2020, 2, 1), "added")],
        "security_id long, effective_on date, action string",
    )
    assert values(I.reconstruct(days), "security_id", "valid_from", "valid_to", "reason") == sorted(
        [(1, date(2020, 1, 1), date(2020, 2, 1), None), (1, date(2020, 3, 1), None, None), (2, None, None, "conflicting"), (3, None, None, "ambiguous"), (4, None, None, "conflicting")], key=repr
    )


def test_three_valued_sides(spark):
    rows = spark.createDataFrame([(datetime(2024, 7, 1, 13, 29), "before_open"), (datetime(2024, 7, 1, 13, 30), "before_open"), (datetime(2024, 7, 1, 16, 59), "after_close"), (datetime(2024, 7, 1, 17, 0), "after_close"), (datetime(2024, 7, 2, 3, 0), "after_close"), (datetime(2024, 7, 2, 5, 0), "after_close")], "ts timestamp, timing string")
    got = [r[0] for r in rows.select(I.side(F.col("ts"), F.lit("2024-07-01").cast("date"), F.col("timing"))).collect()]
    assert got == [None, "after", "before", None, None, "after"]


def test_wall_time(spark):
    rows = spark.createDataFrame([("2024-11-03 01:30:00",), ("2024-03-10 02:30:00",), ("2024-07-01 09:30:00",)], "t string")
    assert [r[0] for r in rows.select(I.wall_time_utc(F.col("t"))).collect()] == [None, None, datetime(2024, 7, 1, 13, 30)]


def test_state_log(spark):
    at = datetime(2024, 1, 1)
    log = spark.createDataFrame(
        [("d", "r1", 1, at, None, "expected", "waiting", None, None), ("d", "r1", 2, at, "expected", "acquired", None, None, None), ("d", "r1", 3, at, "acquired", "failed", None, "parse", None), ("d", "r2", 1, datetime(2024, 1, 2), "failed", "acquired", None, None, None), ("e", "r1", 1, at, "expected", "parsed", None, None, None)],
        "document_id string, run_id string, sequence long, recorded_at timestamp, from_state string, to_state string, missing_reason string, failure_reason string, override_id string",
    )
    assert values(ST.checked(log).where("problem is not null"), "document_id", "run_id", "problem") == [("d", "r2", "illegal_transition"), ("e", "r1", "broken_chain")]
    assert values(ST.current(log), "document_id", "to_state") == [("d", "acquired"), ("e", "parsed")]


TEXT = "Sales rose. Costs fell. Sales rose."


def test_span_cascade(spark):
    import hashlib

    h = hashlib.sha256(TEXT.encode()).hexdigest()
    docs = spark.createDataFrame([("d", TEXT, h)], "doc_id string, canonical_text string, canonical_hash string")
    elements = spark.createDataFrame([("d", "paragraph-0-35", 0, 35), ("d", "sentence-0-11", 0, 11)], "doc_id string, element_id string, start int, end int")
    turns = spark.createDataFrame([("d", 0, 15)], "doc_id string, start int, end int")
    ocr = spark.createDataFrame([("d", 20, 22)], "doc_id string, start int, end int")
    p = "paragraph-0-35"
    cases = [
        ("ok", "d", 0, 11, "Sales rose.", h, p, "", " Costs", None), ("null", "d", None, 11, "x", h, p, "", "", "malformed_record"), ("doc", "x", 0, 11, "Sales rose.", h, p, "", "", "wrong_document"),
        ("hash", "d", 0, 11, "Sales rose.", "0", p, "", "", "hash_mismatch"), ("far", "d", 30, 99, "x", h, p, "", "", "out_of_bounds"), ("text", "d", 0, 5, "Costs", h, p, "", "", "text_mismatch"),
        ("element", "d", 0, 5, "Sales", h, "q", "", "", "unknown_element"), ("outside", "d", 12, 17, "Costs", h, "sentence-0-11", "", "", "outside_element"), ("turn", "d", 12, 17, "Costs", h, p, "", "", "crosses_speaker_turn"),
        ("ocr", "d", 18, 23, "fell.", h, p, "", "", "overlaps_ocr_text"), ("context", "d", 0, 5, "Sales", h, p, "", " fell", "context_mismatch"), ("twice", "d", 24, 29, "Sales", h, p, "", " rose", "ambiguous_occurrence"),
    ]
    rows = spark.createDataFrame([c[:-1] for c in cases], "candidate_id string, doc_id string, start int, end int, quote_text string, canonical_hash string, element_id string, prefix string, suffix string")
    got = dict(values(Z.span_problem(rows, docs, elements, turns, ocr), "candidate_id", "reason"))
    assert got == {c[0]: c[-1] for c in cases}


def test_overlap_strips(spark):
    a = spark.createDataFrame([("d", 0, 10_000, "x"), ("d", 9_000, 9_001, "y")], "doc_id string, start int, end int, name string")
    b = spark.createDataFrame([("d", 4_000, 12_500), ("d", 10_000, 10_001)], "doc_id string, start int, end int")
    assert values(Z.overlapping(a, b), "name", "other_start") == [("x", 4000), ("y", 4000)]


def test_masks_left(spark):
    a = spark.createDataFrame([("d", 0, 5), ("d", 50, 60)], "doc_id string, start int, end int")
    m = spark.createDataFrame([("d", 2, 3, "m2"), ("d", 4, 9, "m1")], "doc_id string, start int, end int, mask_id string")
    assert values(Z.masks_over(a, m), "start", "mask_ids") == [(0, ["m1", "m2"]), (50, [])]


def test_text_rules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.occurrences(F.lit("aaaa"), "aa")) == [0, 1, 2]
    assert one(T.occurrences(F.lit("x.y.x"), ".")) == [1, 3] and one(T.occurrences(F.lit("abc"), "")) == []
    assert one(T.normalized(F.lit("  é­ x\x1cy "))) == "é x y"
    assert one(T.char_windows(F.lit("abcd"), 3)) == ["abc", "bcd"]
    assert one(T.exhibit_numbers(F.lit("Exhibit 99.01 and exhibit 99.2"))) == ["99.1", "99.2"]
    assert one(T.boilerplate(F.lit("Forward-Looking Statements involve RISKS"))) == "safe_harbor"
    assert one(T.marked(F.lit("a<b"), F.lit(1), F.lit(2))) == "a<mark>&lt;</mark>b"
    assert one(T.signed_figures(F.lit("(1,200) and 3.5"))) == ["-1200", "3.5"]
    assert one(D.quarters_between(F.lit("2024-02-01").cast("date"), F.lit("2024-08-01").cast("date"))) == ["2024Q1", "2024Q2", "2024Q3"]


def test_sentences():
    text = "Dr. A. Smith met Inc. staff. Next came B! 2 came."
    assert [text[a:b] for a, b in sentence_spans(text)] == ["Dr. A. Smith met Inc. staff.", "Next came B!", "2 came."]
    assert sentence_spans("") == [] and sentence_spans("1. One. Two") == [(0, 7), (8, 11)]


def test_statistics(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0), (None, 1)], "score double, label int")
    assert S.auc(rows).first()["auc"] == 0.875
    assert S.auc(rows.where("label = 1")).first()["auc"] is None
    drawn = S.draws(spark, ["a", "b", "c"], 3, 50)
    assert drawn.groupBy("resample").agg(F.sum("times").alias("n")).where("n <> 3").count() == 0
    sums = spark.createDataFrame([("a", 1, 0), ("b", 1, 0), ("c", 1, 0)], "cluster string, tp long, fp long")
    out = S.bootstrap(sums, drawn, S.ratio(F.col("tp"), F.col("tp") + F.col("fp"))).first()
    assert (out["n_defined"], out["low"], out["high"]) == (50, 1.0, 1.0)
    assert S.kappa_ac1(spark.createDataFrame([(True, True)], "a boolean, b boolean")).first()["kappa"] is None


def test_windows_and_alignment(spark):
    blocks = spark.createDataFrame([("d", i, n) for i, n in enumerate([5, 5, 12, 1, 9])] + [("e", 0, 3)], "doc string, position int, n int")
    assert values(L.packed_windows(blocks, "doc", "position", "n", 10), "doc", "position", "window") == [("d", 0, 0), ("d", 1, 0), ("d", 2, 1), ("d", 3, 2), ("d", 4, 2), ("e", 0, 0)]
    left = spark.createDataFrame([("d", i, t) for i, t in enumerate("abxcx")], "doc_id string, position int, text string")
    right = spark.createDataFrame([("d", i, t) for i, t in enumerate("qabxc")], "doc_id string, position int, text string")
    assert values(L.aligned(left, right), "left_position", "right_position") == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert L.on_every_chain([(0, 0), (1, 2), (2, 1), (3, 3)]) == [(0, 0), (3, 3)]


def test_copies(spark):
    docs = spark.createDataFrame([(c, "e", "i", date(2025, 1, 1), "release", h) for c, h in (("a", "1"), ("b", "1"), ("c", "2"), ("d", "3"))], "doc_id string, event_id string, entity_id string, period_end date, doc_type string, canonical_hash string")
    prints = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "z")], "doc_id string, fingerprint string")
    asserted = spark.createDataFrame([("b", "c")], "a string, b string")
    assert values(L.copy_groups(docs, asserted, prints), "doc_id", "representative_doc_id", "status") == [("a", "a", "copy_processing_conflict"), ("b", "a", "copy_processing_conflict"), ("c", "a", "copy_processing_conflict"), ("d", "d", "consistent")]


def test_contracts(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k long, v string")
    assert values(C.grain_violations(a, ["k"]), "k", "n_rows") == [(1, 2)]
    assert C.schema_problems(a, StructType([StructField("k", LongType()), StructField("v", LongType())])) == ["v is string, not bigint"]
    with pytest.raises(Exception, match="rows of one key differ"):
        C.merge_identical(a, a, ["k"]).collect()
    assert values(C.first_duplicate(a, ["k"], ["v"]), "v") == [("y",)]


def test_publish_and_read(spark, tmp_path):
    schema = StructType([StructField("k", LongType()), StructField("v", StringType())])
    rows = spark.createDataFrame([(1, "x"), (2, None)], schema)
    path = str(tmp_path / "run")
    R.publish({"t": rows}, path, {"t": schema}, {"t": ["k"]}, {"run_id": "r"})
    manifest, tables = R.read_run(spark, path, {"t": schema})
    assert manifest["run_id"] == "r" and tables["t"].count() == 2
    with pytest.raises(FileExistsError):
        R.publish({"t": rows}, path, {"t": schema}, {"t": ["k"]}, {"run_id": "r"})
    with pytest.raises(ValueError, match="rows of one key"):
        R.publish({"t": rows.union(rows)}, path + "2", {"t": schema}, {"t": ["k"]}, {})
    assert R.write_once(spark, str(tmp_path / "f"), "a") and not R.write_once(spark, str(tmp_path / "f"), "a")
    with pytest.raises(FileExistsError):
        R.write_once(spark, str(tmp_path / "f"), "b")
    record = {"name": "x", "n": 1, "none": None, "inner": {"a": [1, 2]}}
    R.write_once(spark, str(tmp_path / "t.toml"), R.toml_text(record))
    assert R.read_toml(spark, str(tmp_path / "t.toml")) == {"name": "x", "n": 1, "inner": {"a": [1, 2]}}
    assert R.next_version({"a": 1}, [{"content_hash": H.digest({"a": 1}), "version": 3}]) == 3 and R.next_version({"a": 2}, [{"content_hash": "x", "version": 3}]) == 4


def test_json_sources(spark):
    rows = spark.createDataFrame([(1, json.dumps({"a": [1, 2], "b": ["x", "y"]}))], "id long, payload string")
    assert values(J.columnar(rows, "payload", {"a": "bigint", "b": "string"}), "position", "a", "b") == [(0, 1, "x"), (1, 2, "y")]
    bad = spark.createDataFrame([(1, '{"a":[1],"b":[]}')], "id long, payload string")
    with pytest.raises(Exception, match="differ in length"):
        J.columnar(bad, "payload", {"a": "bigint", "b": "string"}).collect()
    p = spark.createDataFrame([('{"a":{"b/c":[10,20]}}',)], "p string")
    assert p.select(J.pointer(F.col("p"), "/a/b~1c/1")).first()[0] == "20"
    x = spark.createDataFrame([(1, "<r><invstOrSecs><invstOrSec><name>n</name><cusip>c</cusip><balance>1.5</balance><valUSD>2</valUSD></invstOrSec></invstOrSecs></r>")], "id long, payload string")
    assert values(J.holdings(x, "payload"), "name", "balance") == [("n", 1.5)]


def test_pages():
    assert W.decode_html_bytes(b"\xef\xbb\xbfx")[1:] == ("UTF-8", "bom") and W.decode_html_bytes(b'<meta charset="latin1">\x93')[0][-1] == "“"
    assert W.decode_html_bytes(b"\xff")[2] == "default"
    blocks = W.walk("<h2>Head</h2><p>Text <b>bold</b>.</p><ul><li>one</ul><p>12</p><p>2024</p><table><tr><th>a<th>2020<tr><td>b<td>(5)</table><script>x</script>")
    assert [(b["type"], b["text"]) for b in blocks] == [("heading", "Head"), ("paragraph", "Text bold."), ("list_item", "one"), ("page_artifact", "12"), ("paragraph", "2024"), ("table", "a\t2020\nb\t(5)")]
    assert blocks[-1]["header_rows"] == 1 and W.occupancy([[(1, 2), (1, 1)], [(1, 1)]]) == [[(0, 0), (0, 1)], [(1, 1)]]
    text, elements = W.canonical("<p>One. Two.</p><p>x</p>")
    assert text == "One. Two.\nx" and {e["element_id"] for e in elements} == {"paragraph-0-9", "sentence-0-4", "sentence-5-9", "paragraph-10-11"}


def test_support(spark):
    rows = spark.createDataFrame([("t", "q", "supporting")] * 4 + [("t", "r", "supporting")] * 3 + [("t", "r", None), ("u", "q", "supporting")], "target_id string, quote_id string, contribution string")
    assert values(U.supporting_quotes(rows), "target_id", "quote_id") == [("t", "q")]
    d = spark.createDataFrame([("d1", "doc", "c", "theme", "accepted", ["q"]), ("d2", "doc", "c2", "theme", "accepted", ["q"])], "decision_id string, doc_id string, claim_id string, theme_id string, status string, supporting_quote_ids array<string>")
    e = spark.createDataFrame([("doc", "q", 0, 5, [])], "doc_id string, quote_id string, start int, end int, mask_ids array<string>")
    a, links = U.assignments(d, e)
    assert a.count() == 1 and links.count() == 2
    done = (True,) * 4
    c = spark.createDataFrame([("a", False, *done, True, 1, 0, False, []), ("b", False, *done, True, 0, 0, True, []), ("c", False, *done, True, 0, 0, False, []), ("d", True, *done, True, 1, 0, False, []), ("e", False, *done, True, 1, 1, False, [])], "doc_id string, extraction_failed boolean, traversal boolean, classification boolean, assessment boolean, decision boolean, has_policy boolean, n_assignments int, n_unmatched int, declared_no_theme boolean, reasons array<string>")
    assert values(U.completion(c), "doc_id", "processing_state", "all_reasons") == [("a", "completed", []), ("b", "completed-no-theme", []), ("c", "partial", ["no_theme_unconfirmed"]), ("d", "failed", []), ("e", "partial", ["valid_unmatched"])]


def test_cells(spark):
    cells = spark.createDataFrame([("e", "a", None, True), ("e", "b", "g", True), ("e", "c", "g", True), ("f", "x", "g", True), ("f", "y", "g", True)], "event_id string, theme_id string, tie_group string, present boolean")
    predicted = spark.createDataFrame([("e", "c")], "event_id string, theme_id string")
    got = values(U.resolved_cells(cells, predicted), "event_id", "theme_id", "role")
    assert got == [("e", "a", "gold"), ("e", "b", "excused"), ("e", "c", "gold"), ("f", "x", "gold"), ("f", "y", "excused")]


def test_sample_extends(spark):
    pool = spark.createDataFrame([(f"e{i % 5}", f"t{i % 3}", f"x{i}") for i in range(100)], "event_id string, theme_id string, target_id string")
    small, large = (set(values(X.stratified_sample(pool.repartition(n), 1, 6, size), "target_id")) for n, size in ((3, 10), (7, 20)))
    assert len(small) == 10 and len(large) == 20 and small < large


def test_pilot():
    events = [{"event_id": f"e{i}", "issuer_id": f"i{i % 6}", "quarter": f"2024Q{i % 4 + 1}", "day": i * 30} for i in range(30)]
    a, b = X.pilot(events, 5, 12, ["2024Q1"]), X.pilot(list(reversed(events)), 5, 12, ["2024Q1"])
    assert [e["event_id"] for e in a] == [e["event_id"] for e in b] and len(a) == 12 and {e["issuer_id"] for e in a} == {f"i{i}" for i in range(6)}


def test_canonical_json():
    assert H.canonical_json({"b": date(2024, 1, 2), "a": ["é"]}) == '{"a":["é"],"b":"2024-01-02"}'
    record = H.sealed({"x": 1})
    assert H.is_sealed(record) and not H.is_sealed(record | {"x": 2})


def test_streams(spark, tmp_path):
    from evidentia.streaming import state_log as G

    src = str(tmp_path / "log")
    spark.createDataFrame([("d", 1, "expected", None), ("d", 2, "acquired", None), ("d", 3, "completed", None), ("d", 4, "parsed", None)], "document_id string, sequence long, to_state string, override_id string").write.parquet(src)
    stream = spark.readStream.schema("document_id string, sequence long, to_state string, override_id string").parquet(src)
    query = G.tracked(stream).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert values(spark.table("tracked"), "sequence", "accepted") == [(1, True), (2, True), (3, False), (4, True)]
    out = str(tmp_path / "out")
    for n in range(2):
        again = spark.readStream.schema("document_id string, sequence long, to_state string, override_id string").parquet(src)
        G.append_new(again, out, ["document_id", "sequence"], str(tmp_path / f"c{n}")).awaitTermination(60)
    assert spark.read.parquet(out).count() == 4


def test_shingle_hits_both_ways(spark, monkeypatch):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé𝄞") for _ in range(rng.randint(1, 5)))
    label = [(f"l{i}", " ".join(word() for _ in range(30)) + (" On March 3, 2020 it was so and so." if i == 1 else "")) for i in range(6)] + [("none", None), ("short", "x")]
    texts = [(i, " ".join(word() for _ in range(20)) + (label[i % 6][1][i : i + 36 + i % 9] if i % 2 else "") + " ".join(word() for _ in range(20))) for i in range(60)]
    texts += [(60, None), (61, ""), (62, "was. On July 14, 1999 it was so and so. But"), (63, "x" * 70_000 + label[2][1] + "y"), (64, label[3][1]), (64, label[3][1])]
    a, b = spark.createDataFrame(label, "label_id string, text string"), spark.createDataFrame(texts, "text_id long, text string").repartition(3)

    def windows(text):
        masked = re.sub(r"\b(?:March|July) [0-9]+, [0-9]{4}\b", "\0", text or "")
        return {masked[i : i + 40] for i in range(len(masked) - 39)}

    want = sorted({(n, i) for n, x in label for i, y in texts if windows(x) & windows(y)}, key=repr)
    assert values(L.shingle_hits(a, b), "label_id", "text_id") == want and len(want) > 8
    monkeypatch.setattr(L, "TOLD_CHARS", 0)
    assert values(L.shingle_hits(a, b), "label_id", "text_id") == want
