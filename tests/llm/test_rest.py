"""Toxicity, top-k, page text, sharding, the pipeline and the registered queries."""

from __future__ import annotations

import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from evidentia.llm import queries
from evidentia.llm.html_extract import extract, extract_pages
from evidentia.llm.sharding import shard, shard_documents
from evidentia.llm.topk import Blocks, top_k
from evidentia.llm.toxicity import BUCKETS, Features, fit, noisy_or, score_documents, score_table, sentence_spans, train, without_toxic


def labelled(seed=1, n=600):
    rng = random.Random(seed)
    plain, bad = [f"word{i}" for i in range(300)], ["grunk", "snarf", "blorpish", "blorpen"]
    rows = []
    for i in range(n):
        sentences = [" ".join(rng.choice(plain) for _ in range(8)).capitalize() + "." for _ in range(rng.randint(1, 12))]
        toxic = rng.random() < 0.3
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] = sentences[at].replace(".", f" {rng.choice(bad)} {rng.choice(plain)}.")
        rows.append((i, " ".join(sentences), int(toxic)))
    return rows


def test_toxicity_held_out_and_located(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(10_000, "", "s"), (10_001, None, "s"), (None, "word1 grunk", "s"), (5, rows[5][1], "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = score_table(docs, labels).collect()
    assert len(got) == len(rows) + 4
    by_id = {r["doc_id"]: r for r in got}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in by_id if i is not None and by_id[i]["held_out"] and i < 10_000} == set(held)
    right = sum(by_id[i]["predicted"] == rows[i][2] for i in held)
    assert right >= 0.95 * len(held)
    located = [i for i in held if rows[i][2] and by_id[i]["worst_start"] is not None]
    assert sum(any(w in rows[i][1][by_id[i]["worst_start"] : by_id[i]["worst_end"]] for w in ("grunk", "snarf", "blorp")) for i in located) >= 0.9 * len(located) > 10
    for r in got:
        assert (r["offending"] is None) == (r["score"] < 0.3)
        assert r["offending"] is None or (r["worst_start"], r["worst_end"], r["worst_score"]) in [tuple(s) for s in r["offending"]] and all(s["score"] >= min(0.3, r["worst_score"]) for s in r["offending"])
    two = score_documents(docs.limit(0).unionByName(spark.createDataFrame([(1, "word1 word2. grunk word3. word4 word5. word7 snarf.", "")], docs.schema)), train(docs, labels)).first()
    assert [("word1 word2. grunk word3. word4 word5. word7 snarf."[s["start"] : s["end"]]).strip() for s in two["offending"]] == ["grunk word3.", "word7 snarf."]
    assert by_id[10_000]["score"] == 0 and by_id[10_001]["predicted"] == 0 and by_id[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)


def test_toxicity_without_lessons(spark):
    docs = spark.createDataFrame([(1, "a b."), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in score_table(docs, none).collect()] == [0, 0]
    assert score_table(docs.where("1 = 0"), none).count() == 0
    assert fit(["a", "b"], [1, 1]).bias > 0 and train(docs, none).bias < 0
    assert noisy_or(np.array([0.5, 0.5])) == 0.75 and sentence_spans("A b. C!\nd") == [(0, 4), (4, 7), (8, 9)]


def test_training_lowers_the_plain_noisy_or_loss():
    """The fitted weights against a plain computation of the loss of documents, sentence by sentence."""
    rows = labelled(5, 250)
    texts, marks = [t for _, t, _ in rows], [k for _, _, k in rows]
    model, features = fit(texts, marks), Features()

    def loss(weights, bias):
        total = 0.0
        for text, mark in zip(texts, marks, strict=True):
            none = 1.0
            for a, b in sentence_spans(text):
                z = bias + sum(weights[i] for i in {i for w in set(re.findall(r"\w+", text[a:b].lower())) for i in features.of(w)})
                none *= 1 - 1 / (1 + math.exp(-z))
            whole = min(max(1 - none, 1e-9), 1 - 1e-9)
            total -= math.log(whole) if mark else math.log(1 - whole)
        return total / len(texts)

    own = loss(model.weights, model.bias)
    assert own < 0.1 * loss(np.zeros(BUCKETS), math.log(0.04))
    used = np.flatnonzero(model.weights)
    rng = np.random.default_rng(1)
    for _ in range(5):
        other = model.weights.copy()
        other[used] += rng.normal(size=len(used)) * 2
        assert loss(other, model.bias) > own


def test_sample_reads_lengths_first(spark, monkeypatch):
    import evidentia.llm.toxicity as T

    monkeypatch.setattr(T, "SAMPLE_CHARS", 12)
    docs = spark.createDataFrame([(i, "x" * 5) for i in range(6)] + [(0, "y" * 5)] * 3 + [(7, "z" * 100), (8, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    texts, marks, share = T.sample(docs, labels, None, longest=50)
    assert sorted(marks) == [0, 0, 1, 1] and set(map(len, texts)) == {5} and share == 4 / 9
    assert T.sample(docs.where("1 = 0"), labels, None)[:2] == ([], [])


def test_held_out_labels_teach_nothing(spark):
    rows = labelled(3, 200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = [(i, k) for i, _, k in rows]
    flipped = [(i, 1 - k if zlib.crc32(str(i).encode()) % 4 == 2 else k) for i, k in labels]
    a, b = (train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert a.bias == b.bias and np.array_equal(a.weights, b.weights)


def test_top_k(spark, monkeypatch):
    import evidentia.llm.topk as K

    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8).round(1)], "l") for i in range(400)] + [(3, [1.0] * 8, "l"), (401, None, "l"), (402, [None] * 8, "l"), (None, [9.0] * 8, "l"), (403, [float("inf")] * 8, "l"), (404, [0.5] * 3, "l")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row string").repartition(3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(frame, k=4).collect())
    good = [(i, [int(np.floor(256 * x)) for x in v] + [0] * (8 - len(v))) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for q, x in good:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in good if i != q)[:4]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    monkeypatch.setattr(K, "BLOCK", 8)
    monkeypatch.setattr(K, "BUNDLE", 4)
    monkeypatch.setattr(K, "BATCH", 2)
    for told in (1 << 20, 0):
        monkeypatch.setattr(K, "TOLD", told)
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(frame, k=4).collect()) == sorted(want)
    assert top_k(frame.where("1 = 0")).count() == 0 and top_k(frame.where("vec_id = 50")).count() == 0


def test_blocks_prune_and_stay_exact():
    rng = np.random.default_rng(3)
    q = np.concatenate([rng.integers(-5, 6, (900, 6)), rng.integers(50, 60, (100, 6))])
    ids = np.arange(1000)
    blocks = Blocks(ids, q, 60, size=50)
    query = np.array([3, 1, 4, 1, 5, 9])
    found, scores = blocks.search(-1, query, blocks.bounds(query[None])[0], 5)
    s = q @ query
    assert found.tolist() == sorted(range(1000), key=lambda i: (-s[i], i))[:5] and scores.tolist() == sorted(s.tolist(), reverse=True)[:5]
    assert (blocks.bounds(query[None])[0].reshape(-1, 1) >= s.reshape(20, 50)).all()
    big = Blocks(ids[:3], np.array([[2**40], [-(2**40)], [5]]), 2**20)
    assert big.search(9, np.array([2**20]), big.bounds(np.array([[2**20]]))[0], 2)[1].tolist() == [2**60, 5 * 2**20]


def test_bundles_are_ruled_out_on_clustered_vectors():
    """With clusters far apart, floors from the own cell leave only the bundles that hold the best, and all of these."""
    from evidentia.llm.topk import reached

    rng = np.random.default_rng(5)
    centers = rng.integers(-200, 200, (40, 16))
    bundles = centers[:, None] + rng.integers(-3, 4, (40, 50, 16))
    queries = bundles[:, 0]
    scores = np.einsum("qd,bnd->qbn", queries, bundles)
    for n in range(40):
        floor = np.sort(scores[n, n])[-5:][:1].astype(float)
        hit = reached(queries[n : n + 1], floor, bundles.min(1), bundles.max(1))
        assert hit[(scores[n] >= floor).any(1)].all() and hit.sum() <= 6
        assert reached(queries[n : n + 1], np.array([-np.inf]), bundles.min(1), bundles.max(1)).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>"; </script></head><body>
<header><div>Site</div></header><nav><ul><li><a href=x>Menu, one.</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy, now.</div>
%s<aside><p>Other, things.</p></aside><div class="cookie-notice">We use, cookies.</div><form><p>Search, here</p></form>
<section id="comments"><p>Nice, read.</p></section><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><h1>Head &amp; line</h1><p><b>Bold&nbsp;start.<br>\n<p>Second <i>it</i>alic, text.</p><ul><li>one<li>two, <a href=y>link</a></ul></article>", "Head & line\n\nBold start.\n\nSecond italic, text.\n\none\n\ntwo, link"),
        ("<div class=content><h2>Head</h2><p>A longer text, with marks; and more. Yes.<p>Another long text, with marks, and so on.</div>", "Head\n\nA longer text, with marks; and more. Yes.\n\nAnother long text, with marks, and so on."),
        ("<main><p>a < b, and 3 &lt; 4.</p><div class='share-bar'>Share</div></main>", "a < b, and 3 < 4."),
        ("", ""),
    ],
)
def test_page_text(body, want):
    assert extract(PAGE % body) == want


def test_sample_leaves_out_longer_texts(spark):
    from evidentia.llm.toxicity import sample

    docs = spark.createDataFrame([(1, "short"), (2, "a longer text"), (3, "bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "doc_id long, toxic int")
    assert sample(docs, labels, None, longest=5)[:2] == (["short", "bad"], [0, 1])
    assert sorted(sample(docs, labels, None)[0]) == ["a longer text", "bad", "short"]


def test_page_text_by_scores_beside_and_inside_articles():
    main = "".join(f"<p>Sentence one of {i}, which is long enough. Sentence two, of {i}, follows it; and a third.</p>" for i in range(6))
    text = "\n\n".join(f"Sentence one of {i}, which is long enough. Sentence two, of {i}, follows it; and a third." for i in range(6))
    assert text in extract(f"<body><div>{main}</div><article><a href=x>A teaser</a></article></body>")
    chips = "<div class=chips>" + "<span>go</span><br>" * 12 + "</div>"
    assert extract(f"<body><article>{main}{chips}</article></body>") == text
    assert extract("<body><article><p>no marks at all in here</p></article></body>") == "no marks at all in here"


def laid_out_pages(n=30):
    """(html, main text) of pages without article elements, in several layouts, their content marked by hand."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(6, 16))).capitalize() + rng.choice([".", ".", "!", "; and so on."])
    for i in range(n):
        paragraphs = [" ".join(sentence() for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(4, 9))]
        title = " ".join(word() for _ in range(5)).capitalize()
        menu = "".join(f"<li><a href=/{word()}>{word()} {word()}</a>" for _ in range(rng.randint(5, 12)))
        side = "".join(f"<li><a href=x>{sentence()}</a></li>" for _ in range(3))
        body = "".join(f"<p>{p}" + rng.choice(["", "</p>"]) for p in paragraphs)
        wrap = [("<div class=post>", "</div>"), ("<table><tr><td width=70%>", "</table>"), ("<div id=c><div><section>", "</section></div></div>"), ("<center>", "</center>"), ("", "")][i % 5]
        head = rng.choice([f"<h1>{title}</h1>", f"<h2><b>{title}</b></h2>"])
        junk = f"<div id=top><ul>{menu}</ul></div>", f"<div class='box'><ul>{side}</ul></div>", f"<div id=bottom><a href=a>{word()}</a> | <a href=b>{word()}</a></div>"
        comments = rng.choice(["", f"<div id='comments'><p>{sentence()}</p></div>"])
        yield f"<html><head><title>{title}</title><body>{junk[0]}{wrap[0]}{head}{body}{wrap[1]}{junk[1]}{comments}{junk[2]}", "\n\n".join([title, *paragraphs])


@pytest.mark.parametrize(("html", "want"), list(laid_out_pages()))
def test_pages_without_article_elements(html, want):
    assert extract(html) == want


def test_the_scores_decide(monkeypatch):
    import evidentia.llm.html_extract as H

    pages = [h for h, _ in laid_out_pages()] + [PAGE % "<article><h1>H</h1><p>One, two.</p></article>"]
    before = [extract(h) for h in pages]
    monkeypatch.setattr(H, "path_scores", lambda nodes: dict.fromkeys({n.path for n in nodes}, 0.0))
    assert all(a and a != extract(h) for a, h in zip(before, pages, strict=True))


def test_names_inside_the_article():
    body = "<article><p>First of all, this.</p><p class=more>Second, that.</p><section class='related work'><p>Third, those.</p></section><div class=ad>Buy, now.</div><div class='share-bar'>Share, this.</div></article>"
    assert extract(f"<body>{body}<div class=related><p>Other, things.</p></div></body>") == "First of all, this.\n\nSecond, that.\n\nThird, those."
    assert extract("<div class=post><p>Real text one without marks</p><p>Real text two without marks</p></div>") == "Real text one without marks\n\nReal text two without marks"


@pytest.mark.parametrize("html", ["<a " * 300_000, "<div>" * 300_000 + "x, y.", "<!" * 300_000, "</script " * 100_000, "<b><div>" + "<span>" * 50_000 + "</b>" * 50_000, "<" * 500_000, "<a b='" * 200_000, "<p =" * 200_000, "<script>" * 200_000, "<ul>" + "<li>a, b" * 100_000, "<x>" * 100_000 + "</y>" * 100_000])
def test_odd_pages_take_linear_time(html):
    import time
    import tracemalloc

    began = time.perf_counter()
    extract(html)
    assert time.perf_counter() - began < 20
    tracemalloc.start()
    extract(html[: len(html) // 4])
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_markup_as_browsers_read_it():
    assert extract("<article><p title=\"a > b\">One, two.<p data-x=5\">Three, four.</p></article>") == "One, two.\n\nThree, four."
    assert extract("<article><p>Kept, here.</p><svg><text>no</text></svg><noscript>no, no.</noscript><p>And, there.</article>") == "Kept, here.\n\nAnd, there."
    assert extract("<article><p>Kept, here.</p><object><p>lost, too.</article><p>") == "Kept, here."
    deep = "<div>" * 600 + "<nav>menu, one.</nav><p>Deep, text." + "</div>" * 600
    assert extract(deep) == "Deep, text."


def test_pages_table(spark):
    rows = [(1, "u", PAGE % "<article><p>x, y.</p></article>", "n"), (2, None, None, "n"), (None, "v", "", "n"), (3, "w", "<p>" + "long, text. " * 50_000, "n"), (4, "w", "<<<>>", "n"), (4, "w", "<script>", "n")]
    got = {(r["page_id"], r["url"]): (r["text"][:9], r["n_chars"]) for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[1, "u"] == ("x, y.", 5) and got[2, None] == ("", 0) and got[None, "v"] == ("", 0) and got[3, "w"] == ("long, tex", 599_999)
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 39, 40, 41, 1000])
def test_sharding(spark, n):
    docs = spark.range(n).selectExpr("id as doc_id", "concat('é', id) as text", "'x' as n", "1 as shard")
    rows = shard_documents(docs, 7).collect()
    assert sorted(r["slot"] * 7 + r["shard"] for r in rows) == list(range(n))
    for r in rows:
        text = f"é{r['doc_id']}".encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 16, zlib.crc32(text), "rows", None)
    if n == 1000:
        again = {r["doc_id"]: (r["shard"], r["slot"]) for r in shard_documents(docs.repartition(13), 7).collect()}
        assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
        other = {r["doc_id"]: (r["shard"], r["slot"]) for r in shard_documents(docs, 7, seed=18).collect()}
        assert sum(other[k] == v for k, v in again.items()) < 30
        assert abs(np.corrcoef([r["row_number"] for r in rows], [r["slot"] * 7 + r["shard"] for r in rows])[0, 1]) < 0.15


def test_sharding_against_a_plain_walk(spark):
    """Each row's place by a plain Feistel network with cycle walking."""
    import struct

    import xxhash

    from evidentia.llm.sharding import ROUNDS

    def keyed(value, k, seed, modulus):
        h = 42
        for fmt, x in (("<q", value), ("<i", k), ("<q", seed)):
            h = xxhash.xxh64_intdigest(struct.pack(fmt, x), h)
        return (h - (1 << 64) if h >> 63 else h) % modulus

    for n in (1, 5, 97, 400):
        a = math.ceil(math.sqrt(n))
        b = math.ceil(n / a)
        docs = spark.range(n).selectExpr("id as doc_id", "cast(id as string) as text")
        for r in shard_documents(docs, 7).collect():
            place = r["row_number"]
            while True:
                left, right = place % a, place // a
                for k in range(ROUNDS):
                    if k % 2 == 0:
                        left = (left + keyed(right, k, 17, a)) % a
                    else:
                        right = (right + keyed(left, k, 17, b)) % b
                place = right * a + left
                if place < n:
                    break
            assert r["slot"] * 7 + r["shard"] == place


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Every stage alone over nulls, empty and long texts, repeated rows, extra columns with clashing names, and no rows."""
    import corpus_pipeline

    long = " ".join(f"w{i % 977} v{i % 131}." for i in range(30_000))
    rows = [(1, "A text. It is fine.", "x", 3, 9), (1, "A text. It is fine.", "x", 3, 9), (None, None, None, None, None), (2, "", "y", 0, 1), (3, long, "y", None, 2), (4, long + " end", "y", None, 2), (None, "alone here", None, 1, 1)]
    schema = "doc_id long, text string, rid string, n_chars int, `key` int"
    spark.createDataFrame([(1, 0, 0), (3, 1, 0), (4, 0, 0), (2, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            got = out.collect()
            assert bool(got) == bool(docs.count())
            if name != "packing":
                assert out.columns == docs.columns
            if name == "near_dedup" and got:
                assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in got) == sorted([(1, 19), (0, 0), (2, 0), (3, len(long)), (0, 10)])
            if name == "suffix_dedup" and got:
                left = {r["doc_id"]: r["text"] for r in got}
                assert len(got) == len(rows) and left[3] == long and left[4] == " end"


def test_pipeline_against_plain_stages(spark, tmp_path):
    """What the pipeline keeps and packs, against a plain run of its stages around the same model."""
    import corpus_pipeline
    from evidentia.llm.tokens import byte_bpe, token_file

    rows = labelled(7, 260)
    base = " ".join(f"common{i} passage" for i in range(14))
    texts = [(i, t + (f" {base} {i}" if i % 9 == 0 else "")) for i, t, _ in rows] + [(1000 + i, rows[i][1]) for i in range(0, 40, 4)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    good = {r["doc_id"] for r in score_table(docs, labels).collect() if r["predicted"] == 0}
    kept = dict(x for x in texts if x[0] in good)
    sets = {i: set(zip(*[t.lower().split()[n:] for n in range(5)], strict=False)) or {tuple(t.lower().split())} for i, t in kept.items()}
    parent = {i: i for i in kept}
    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = a, b
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[max(x, y)] = min(x, y)
    kept = {i: t for i, t in kept.items() if parent[i] == i}
    seen, want, bpe = set(), {}, byte_bpe(token_file("byte_bpe_50k.json"))
    for i in sorted(kept):
        data = kept[i].encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            gone[p : p + 100] |= data[p : p + 100] in seen
            seen.add(data[p : p + 100])
        want[i] = len(bpe.library.encode(np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "ignore"), add_special_tokens=False).ids) + 1
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {}
    for r in packed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want and len(want) < len(texts) - 10


def test_sharding_repeats_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a")] * 50 + [(None, None)] * 3 + [(2, None)], "doc_id long, text string")
    rows = shard_documents(docs, 4).collect()
    assert len(rows) == 54 and sorted(r["slot"] * 4 + r["shard"] for r in rows) == list(range(54))
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(1, 17, zlib.crc32(b"a")), (None, 16, 0), (2, 16, 0)}
    assert shard(docs, ["doc_id"], 3).count() == 54


def test_sharding_is_native(spark, small):
    plan = queries.QUERIES["op10_sharding"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline(spark, small):
    import corpus_pipeline

    docs, counts = spark.read.parquet(f"{small}/documents.parquet"), []
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, small))
        assert docs.columns == names
        counts.append(docs.count())
    assert counts[0] >= counts[1] == counts[2] > 0
    packed = corpus_pipeline.run(spark, small)
    assert packed.select("doc_id").distinct().count() == counts[2]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_or_match(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    names, rows = sorted(df.columns), df.collect()
    assert rows
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("embeddings", "documents"):
            con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
        cursor = con.execute(queries.ORACLE_SQL[name])
        theirs = [d[0] for d in cursor.description]
        assert sorted(theirs) == names
        assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(tuple(r[theirs.index(c)] for c in names) for r in cursor.fetchall())
