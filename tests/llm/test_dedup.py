"""Near copies, repeated spans, near vectors and components against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from evidentia.llm import suffix_dedup as X
from evidentia.llm.embed_dedup import linked_pairs, near_vectors
from evidentia.llm.minhash import connected, near_documents, shingles, signature, without_near_copies
from evidentia.llm.suffix_dedup import SuffixFamily, repeated_spans, without_repeats
from evidentia.operators.components import components


def joined(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = joined(pairs, {x for p in pairs for x in p})
    assert got == {n: want[n] for n in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_copies(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(("  " if rng.random() < 0.3 else " ").join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    return texts + ["a b c", "A B  c\n", "", None, " \n ", "a b c d", "É b c d e f", "é b c d e f"]


def test_near_documents(spark):
    texts = near_copies()
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    random.Random(0).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, rep string, posting string").repartition(5)
    got = {r["doc_id"]: r for r in near_documents(docs).collect()}
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = joined(links, range(len(texts)))
    for i, s in enumerate(sets):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s), want[i], want[i] == i), texts[i]
    kept = without_near_copies(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in want if want[i] == i}


def test_agreeing_coordinates():
    from evidentia.llm.minhash import agreeing

    assert (agreeing(85), agreeing(80)) == (41, 36)


def test_the_pipeline_links_from_80_percent_on(spark):
    import corpus_pipeline

    texts = [t for t in near_copies() if t]
    sets = [shingle_set(t) for t in texts]
    at = lambda p: joined([(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j])], range(len(texts)))
    want, before = at(80), at(85)
    assert want != before
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {i for i in want if want[i] == i}


def test_near_documents_edges(spark):
    rows = [(1, "a b c"), (2, "A b C"), (None, "a b c"), (8, "x y z w v"), (8, "x y z w v"), (9, "q"), (9, "x y z w v"), (None, None), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_documents(docs).collect()), key=repr)
    assert got == sorted([(1, 1, 1), (2, 1, 1), (None, 1, 1), (8, 1, 8), (8, 1, 8), (9, 1, 9), (9, 1, 8), (None, 0, None), (None, 1, None)], key=repr)
    assert near_documents(docs.where("1 = 0")).count() == 0
    assert sorted(((r[0], r[1]) for r in without_near_copies(docs).collect()), key=repr) == sorted([(1, "a b c"), (8, "x y z w v"), (9, "q"), (None, None), (None, "alone")], key=repr)


def test_shingles_of_long_words(monkeypatch):
    import evidentia.llm.minhash as M

    text = np.frombuffer(("ab " * 30 + "c" * 100 + " d e f g").encode(), np.uint8)
    whole = shingles(text)
    monkeypatch.setattr(M, "PIECE", 64)
    assert len(shingles(text)) == len(whole)


def test_signature_skipping():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(30)]
    near = [np.unique(np.concatenate([b[15:], rng.integers(0, 2**63, 15).astype(np.uint64)])) for b in base[:10]]
    a, b = connected(signature(base + near))
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} == {(i, 30 + i) for i in range(10)}


def test_agreeing_rows_share_a_posting():
    import evidentia.llm.minhash as M

    rng = np.random.default_rng(3)
    for _ in range(300):
        x = rng.integers(0, 2**32, 64).astype(np.uint32)
        y = x.copy()
        y[rng.permutation(64)[: 64 - M.MATCHES]] = 7
        both = np.stack([x, y])
        hashes = M.posting_hashes(both)
        frequent = np.unique(hashes[rng.integers(0, 2), rng.permutation(64)[: rng.integers(0, 65)]])
        row, found = M.postings(both, frequent)
        assert set(found[row == 0].tolist()) & set(found[row == 1].tolist())


def test_near_documents_with_a_common_passage(spark, monkeypatch):
    import evidentia.llm.minhash as M

    monkeypatch.setattr(M, "LIST", 12)
    monkeypatch.setattr(M, "OFTEN", 12)
    monkeypatch.setattr(M, "SHINGLES", 900)
    monkeypatch.setattr(M, "STAR", 6)
    monkeypatch.setattr(M, "LEAST", 12)
    passage = " ".join(f"common{i}" for i in range(40))
    texts = [f"{t} {passage}" for t in near_copies(5) if t] + [" ".join(f"hot{i}" for i in range(60)) + f" {n}" for n in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = joined(links, range(len(texts)))
    assert {r["doc_id"]: r["component_id"] for r in near_documents(docs).collect()} == want


def test_cells_of_long_lists(spark, monkeypatch):
    """Groups that no single node links, and nodes that their leader does not reach, are connected over cells."""
    import evidentia.llm.minhash as M

    rng = random.Random(12)
    value = {n: rng.randrange(3) * 1000 + rng.randrange(60) for n in range(400)}
    rows = spark.createDataFrame([(n % 2, n) for n in value], "key long, node long")
    payload = spark.createDataFrame(list(value.items()), "node long, value long")
    sizes = rows.groupBy("key").agg(M.F.count("*").alias("size"), M.F.min("node").alias("leader")).withColumn("cells", M.F.ceil(M.F.col("size") / 9).cast("int")).withColumn("coarse", M.F.ceil(M.F.col("size") / 30).cast("int"))

    def near(values):
        x = np.array(values)
        return np.nonzero(np.triu(np.abs(x[:, None] - x[None]) <= 1, 1))

    edges = M._connected_in_cells(rows, sizes, payload, "value", M._within(near, "value", list))
    got = joined([(r["a"], r["b"]) for r in edges.where("b is not null").collect()], value)
    links = [(a, b) for a in value for b in range(a % 2, a, 2) if abs(value[a] - value[b]) <= 1]
    assert got == joined(links, value)
    assert {M._reached(0, np.array([1, 2, 4]), np.array([0, 1, 5]), 6).tolist().count(True)} == {3}


def test_hubs(spark, monkeypatch):
    import evidentia.operators.components as C

    monkeypatch.setattr(C, "HUB", 5)
    pairs = [(0, i) for i in range(3, 90)] + [(i, 200) for i in range(80, 120)] + [(500, i) for i in range(501, 540)] + [(2, None), (700, 701)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = joined([p for p in pairs if None not in p], {x for p in pairs if None not in p for x in p})
    assert got == want


def test_copied_rows_keep_odd_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, "x", None), (2, "A b c", 6, "y", 1.0), (3, None, 7, "z", None)], "doc_id int, text string, __key int, `row.id` string, key double")
    assert sorted(map(tuple, without_near_copies(docs).collect())) == [(1, "a b c", 5, "x", None), (3, None, 7, "z", None)]


def removed(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            gone[p : p + 100] |= w in seen
            seen.add(w)
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[i] = (len(data), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(5)
    base = ["".join(rng.choice("ab ") for _ in range(400)) for _ in range(6)]
    rows = [(1, "a" * 1000), (2, "ab" * 300), (3, "x" + "a" * 500 + "y"), (4, ""), (5, None), (6, "short"), (7, "é" * 120), (8, "\x00" * 150), (9, "\x00" * 99 + "a" + "\x00" * 150), (10, "a" * 99)]
    for i in range(11, 200):
        b, c, a, n = rng.choice(base), rng.choice(base), rng.randint(0, 300), rng.randint(60, 300)
        rows.append((i, rng.choice(["", "q", "zz"]) + b[a : a + n] + rng.choice(["", "#", "##"]) + c[: rng.randint(0, 250)]))
    rng.shuffle(rows)
    return rows


def test_repeated_spans(spark, passages):
    docs = spark.createDataFrame([(i, t, "k", 3) for i, t in passages], "doc_id long, text string, key string, n_chars int").repartition(6)
    assert {r[0]: tuple(r)[1:] for r in repeated_spans(docs).collect()} == removed(passages)
    cut = without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(passages)
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    assert repeated_spans(docs.where("1 = 0")).count() == 0


def test_repeated_rows_and_missing_ids(spark):
    text = "".join(random.Random(9).choices("abcdef ", k=150))
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (3, text)], "doc_id long, text string").coalesce(1)
    got = sorted(((r["doc_id"], r["n_removed"]) for r in repeated_spans(docs).collect()), key=repr)
    assert got == sorted([(3, 0), (7, 150), (7, 150), (None, 150)], key=repr)


def test_families_of_any_size(spark, monkeypatch, passages):
    """Small batches and families that are closed early give the same spans."""
    monkeypatch.setattr(X, "BATCH", 50)
    monkeypatch.setattr(X, "FAMILY", 300)
    batches = [pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([n]), pa.array([t], pa.string())], names=["doc_id", "rid", "text"]) for n, (i, t) in enumerate(sorted(passages))]
    asked = {}
    for b in X._cut(iter(batches)):
        for r in b.to_pylist():
            asked.setdefault(r["rid"], []).append({"key": r["key"], "at": r["at"] if r["at"] >= 0 else ~r["at"]})
    kind = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int64())]))
    for often in (np.zeros(0, np.int64), np.unique([a["key"] for x in asked.values() for a in x])):
        fetched = [r for b in batches if b["rid"][0].as_py() in asked for f in X._fetched(often)(iter([b.append_column("asked", pa.array([asked[b["rid"][0].as_py()]], kind))])) for r in f.to_pylist()]
        fetched.sort(key=lambda r: tuple(r[c] for c in ("key", "part", "ord", "rid", "start")))
        whole = pa.Table.from_pylist(fetched, X._FETCHED).to_batches(max_chunksize=90)
        marks = {}
        for b in X._compared(iter(whole)):
            for r in b.to_pylist():
                marks.setdefault(r["rid"], set()).update(range(r["start"], r["end"]))
        assert {rid: len(s) for rid, s in marks.items()} == {n: v[1] for n, (i, v) in enumerate(sorted(removed(passages).items())) if v[1]}


def test_a_family_takes_batches(spark, passages):
    """Three batches in a row give what one batch of the same order gives; levels merge on the way."""
    rows = [(n, t) for n, (_, t) in enumerate(sorted(passages))]
    want, thirds = removed(rows), [rows[:70], rows[70:140], rows[140:]]
    for last in (False, True):
        family, got = X.RepeatFamily(spark), {}
        for n, part in enumerate(thirds):
            docs = spark.createDataFrame(part, "doc_id long, text string").repartition(3)
            got |= {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in family.add(docs, last=last and n == 2).collect()}
        assert got == want
        assert sum(n for _, n in family.levels) > 0 and len({n.bit_length() for _, n in family.levels}) == len(family.levels)


def test_a_later_batch_goes_after_an_earlier_one(spark):
    text = "".join(random.Random(11).choices("abcdefg ", k=300))
    family = X.RepeatFamily(spark)
    first = family.add(spark.createDataFrame([(9, text)], "doc_id long, text string"))
    again = family.add(spark.createDataFrame([(1, "x" + text), (None, None)], "doc_id long, text string"))
    third = family.add(spark.createDataFrame([], "doc_id long, text string"))
    assert [r["n_removed"] for r in first.collect()] == [0] and {r["doc_id"]: r["n_removed"] for r in again.collect()} == {1: 300, None: 0} and third.count() == 0


def test_frequent_anchor_sample(spark, monkeypatch):
    monkeypatch.setattr(X, "LEAST", 4)
    line = "a line that many documents hold, of over thirty-two bytes"
    docs = spark.createDataFrame([(i, f"{i:050d}{line}{i:060d}") for i in range(40)], "rid long, text string")
    assert len(X.frequent_anchors(docs)) > 0 and len(X.frequent_anchors(docs.where("1 = 0"))) == 0


def test_frequent_anchors(spark, monkeypatch):
    """A short line and a longer passage in very many unequal surroundings, over several batches."""
    rng = random.Random(8)
    line, passage = "a common line of some fifty or sixty bytes in all, yes", "".join(rng.choices("xyz", k=104))
    texts = ["".join(rng.choices("abcdefgh", k=rng.randint(60, 160))) + rng.choice([line, passage, line + passage]) + "".join(rng.choices("abcdefgh", k=rng.randint(60, 160))) for _ in range(400)]
    rows = list(enumerate(texts)) + [(1000, line * 3), (1001, passage + "tail" * 30)]
    monkeypatch.setattr(X, "LEAST", 8)
    for parts in (1, 9):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")
        assert {r[0]: tuple(r)[1:] for r in repeated_spans(docs).collect()} == removed(rows)


def test_family_levels():
    rng = random.Random(2)
    family, seen = SuffixFamily(5), set()
    for _ in range(40):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 9))) for _ in range(rng.randint(1, 12))]
        hit = family.add([t.encode() for t in texts]).tolist()
        for w in [t[i : i + 5] for t in texts for i in range(len(t) - 4)]:
            assert hit.pop(0) == (w in seen)
            seen.add(w)
        sizes = [len(x).bit_length() for x in family.levels]
        assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes) and len(family) == len(seen)
        for level in family.levels:
            assert (np.diff(np.argsort(family.windows(level), kind="stable")) == 1).all()


def test_long_texts_are_cut_into_pieces(monkeypatch):
    data = np.frombuffer("".join(random.Random(3).choices("abc", k=3000)).encode(), np.uint8)
    whole = X.segments(data, np.array([len(data)]))
    windows = {}
    for pieces in X._pieces([data.tobytes()], 512):
        for _, offset, part in pieces:
            start, count, key = X.segments(part, np.array([len(part)]))
            for s, c, k in zip(start.tolist(), count.tolist(), key.tolist(), strict=True):
                windows.update({offset + s + i: k for i in range(c)})
    assert windows == {s + i: k for s, c, k in zip(*(x.tolist() for x in whole), strict=True) for i in range(c)}


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    rows = [(i, [float(x) for x in v], int(i % 3)) for i, v in enumerate(base)]
    rows += [(100 + i, [float(x) for x in base[i % 20] * (2 + i % 3) + rng.normal(size=16) * rng.choice([0, 0.05, 0.2])], int(i % 20 % 3)) for i in range(120)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [None] + [1.0] * 15, 1), (503, [float("nan")] * 16, 1), (504, rows[0][1], None), (505, [1.0], 0), (506, [2.0], 0), (507, [float("inf")] * 16, 0), (508, [], 0)]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<double>, label int, tile string").repartition(4)
    got = {r["vec_id"]: r for r in near_vectors(frame).collect()}
    good = {i: np.array(v) for i, v, k in rows if k is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: k for i, _, k in rows}
    links = [(a, b) for a in good for b in good if a < b and label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.98]
    want = joined(links, label)
    assert len(links) > 50
    for i in label:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (sum(i in p for p in links), want[i], want[i] == i), i
    assert near_vectors(frame.where("1 = 0")).count() == 0


def test_tiles_and_cells(spark, monkeypatch):
    import evidentia.llm.embed_dedup as E

    rng = np.random.default_rng(5)
    for tile, length, n in ((7, 3, 150), (16, 12, 300)):
        monkeypatch.setattr(E, "TILE", tile)
        base = rng.normal(size=(n, length))
        base[n // 2 :] = base[: n - n // 2] + rng.normal(size=(n - n // 2, length)) * 0.08
        rows = [(i, [float(x) for x in v], int(i % 5 == 0)) for i, v in enumerate(base)]
        got = {r["vec_id"]: r["n_links"] for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
        u, label = base / np.linalg.norm(base, axis=1, keepdims=True), np.arange(n) % 5 == 0
        assert [got[i] for i in range(n)] == (((u @ u.T >= 0.98) & (label[:, None] == label)).sum(1) - 1).tolist() and sum(got.values()) > 0


def test_repeated_ids_of_unequal_vectors(spark):
    """Rows that share an id are rows of their own: each has its own label, vector, links and component."""
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.01]), (1, "b", [0.0, 1.0]), (4, "b", [1.0, 0.0]), (3, "a", [0.0, 2.0]), (1, "a", [0.0, 1.0])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(1, 0, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]


def test_linked_pairs_stop_early():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 24))
    x[150:] = x[:150] + rng.normal(size=(150, 24)) * 0.12
    basis = np.linalg.qr(rng.normal(size=(24, 24)))[0][:, :8]
    a, b = linked_pairs(x, x, basis, 0.98, True)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted((i, j) for i in range(300) for j in range(i + 1, 300) if u[i] @ u[j] >= 0.98)
