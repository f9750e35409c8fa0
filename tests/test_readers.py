"""Readers, scorers and streams that no query over the tables reaches."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from evidentia.functions import hashing as H
from evidentia.operators import extraction as X, layout as L, spans as Z
from evidentia.sources import columns as C
from evidentia.sources.html import decoded
from evidentia.streaming import state_log as S


def test_decoded_files(spark, tmp_path):
    (tmp_path / "a.htm").write_bytes(b"<meta charset=latin1>\xe9")
    (tmp_path / "b.htm").write_bytes("é".encode())
    got = {r["path"].rsplit("/", 1)[1]: tuple(r)[1:] for r in decoded(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got["a.htm"][:3] == ("<meta charset=latin1>é", "windows-1252", "meta") and got["b.htm"] == ("é", "UTF-8", "valid-utf-8", hashlib.sha256("é".encode()).hexdigest())


def test_bundles(spark, tmp_path):
    text = "One.\nTwo."
    good = {"doc_id": "d", "source_document_id": "s", "canonicalization_version": "v", "canonical_text": text, "canonical_hash": hashlib.sha256(text.encode()).hexdigest(), "elements": [{"element_id": "paragraph-0-4", "type": "paragraph", "start": 0, "end": 4, "parent_id": None}]}
    for name, record in (("a", good), ("b", good | {"doc_id": "e", "canonical_text": "other"}), ("c", {"doc_id": "f"})):
        (tmp_path / f"{name}.json").write_text(json.dumps(record, indent=1))
    rows = C.bundle(spark, str(tmp_path))
    assert {r["doc_id"]: (r["reason"], len(r["elements"] or [])) for r in rows.collect()} == {"d": (None, 1), "e": ("hash_mismatch", 1), "f": ("unreadable", 0)}
    assert rows.where("doc_id = 'd'").select(F.explode("elements").alias("e")).select(H.element_identity(F.col("e.type"), F.col("e.start"), F.col("e.end"))).first()[0] == "paragraph-0-4"


def test_stated_counts(spark):
    rows = spark.createDataFrame([('{"f": [1, 2]}', 2), ('{"f": [1]}', 2), ("{", 1)], "payload string, n int")
    assert [r["reason"] for r in C.stated_count(rows, "payload", "f", "n").collect()] == [None, "row_count", "unreadable"]


def test_scorers(spark):
    rows = spark.createDataFrame([("a b", "a"), ("a", "b c"), (None, "d")], "premise string, hypothesis string")
    assert [r["score"] for r in X.scored(rows, lambda p, h: (h.str.len() / p.str.len()).astype("float64")).collect()][:2] == [pytest.approx(1 / 3), 3.0]


def test_streams(spark, tmp_path):
    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    rows = [(at(1, 1), "a"), (at(1, 5), "a"), (at(2, 1), "b"), (at(9, 1), "a")]
    spark.createDataFrame(rows, "ts timestamp, event_type string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(f"{tmp_path}/in")
    query = S.windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("windowed").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["start"].day, r["event_type"], r["n"]) for r in spark.table("windowed").collect()) == [(1, "a", 2), (2, "b", 1)]
    statements = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 3, 1)), (3, None)], "id int, published_on date")
    applied, late = S.split_late(statements, "2024-02-01")
    assert sorted(r["id"] for r in applied.collect()) == [1, 3] and [r["id"] for r in late.collect()] == [2]


def test_slices_and_extents(spark):
    one = spark.createDataFrame([("héllo",)], "t string")
    assert one.select(Z.sliced(F.col("t"), F.lit(1), F.lit(3))).first()[0] == "él"
    with pytest.raises(Exception, match="leaves the text"):
        one.select(Z.sliced(F.col("t"), F.lit(1), F.lit(9))).collect()
    rows = spark.createDataFrame([("d", i, k) for i, k in enumerate("aohxcy")] + [("e", 0, "x")], "doc string, position int, k string")
    got = L.extended_until(rows, "doc", "position", F.col("k") == "o", F.col("k") == "c", F.col("k"), "v").orderBy("doc", "position").collect()
    assert [r["v"] for r in got] == [None, "o", "o", "o", None, None, None]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from evidentia.session import checkpointing

    held = SimpleNamespace(isEmpty=lambda: True)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: held)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpointing(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))
