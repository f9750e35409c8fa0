"""Token counts, packing and pieces against the tokenizers' own libraries."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from evidentia.llm import token_counts
from evidentia.llm.packing import Bins, first_fit_decreasing, pack
from evidentia.llm.pieces import PieceModel, decode_pieces, encode_pieces, piece_digests
from evidentia.llm.token_counts import count_tokens
from evidentia.llm.tokens import _OTHER, ByteBpe, token_file

ODD = ["", None, " ", "  a  b\n\n c\t\n", "<|endoftext|>x <|endoftext|>", "aՠb 1৴", "don't I'LL 'll 123abc!! ", "\x00\x1c a\x85b c　", "😀 ñ ‍", "\r\n\r\n  x\n y", "x" * 3000, " " * 5000, "▁▁ a▁ b"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "k", 1) for i, t in enumerate(ODD)] + [(3, ODD[3], "k", 1), (None, "no id", "k", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, pieces string, block int")


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(token_file("byte_bpe_50k.json"))


def mixed(alphabet, n, most, seed=2):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


LETTERS = [" ", "  ", "\n", "\t", "a", "b'll", "'s", " the", "foo", "é", "1", "23", "!", "...", "\r\n", "\x85", "\xa0", "\x1c", "<|endoftext|>", "ՠ", "😀", " ", "\x00", "漢字", "…", "—"]


def test_ids_are_the_librarys(bpe):
    for text in mixed(LETTERS, 4000, 12):
        ids = bpe.library.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text) == np.array(ids, "<u4").tobytes(), repr(text)
        assert sum(bpe.counts(bpe.split(text))) == len(ids), repr(text)


def test_plain_characters_split_alike(bpe):
    for c in range(0x250):
        if not _OTHER.search(chr(c)):
            text = f"a{chr(c)}1{chr(c)}! {chr(c)}"
            assert bpe.find(text) == [text[a:b] for _, (a, b) in bpe.library.pre_tokenizer.pre_tokenize_str(text)], hex(c)


def test_counts(spark, odd, bpe, monkeypatch):
    got = {r["doc_id"]: r for r in count_tokens(odd, limit=3).collect()}
    for i, text in enumerate(ODD):
        n = len(bpe.library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((text or "").encode()), n > 3)
    assert count_tokens(odd).count() == len(ODD) + 2 and None in got
    assert count_tokens(odd.where("1 = 0")).count() == 0


def test_large_frequencies_take_several_pairs():
    block = token_counts._Block(1)
    block.add(5, 10, ["a"] * 200_000 + ["b"])
    rows = [r for batch in block.rows() for r in batch.to_pylist()]
    found = {r["pretoken"]: np.frombuffer(r["postings"], token_counts._PAIR) for r in rows if r["pretoken"]}
    assert found["a"]["freq"].astype(int).sum() == 200_000 and len(found["a"]) == 4 and found["b"]["freq"].tolist() == [1]


def test_packing(spark, odd, bpe):
    rows = pack(odd, length=64).collect()
    ids = {i: bpe.library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(ODD)}
    seen = {}
    for r in rows:
        if r["doc_id"] is None or r["doc_id"] == 3:
            continue
        want = np.array(ids[r["doc_id"]], "<u4")
        assert r["doc_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(want[r["start"] : r["start"] + r["length"]].tobytes())
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for i, spans in seen.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at and 0 < length <= 64
            at += length
        assert at == len(ids[i])
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert pack(odd.where("1 = 0")).count() == 0


def test_first_fit_decreasing_is_plain_first_fit():
    rng = random.Random(4)
    for _ in range(50):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 60))]
        where, offset = first_fit_decreasing(np.array(sizes), 20)
        room = []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            at = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            room += [20] * (at == len(room))
            assert (where[i], offset[i]) == (at, 20 - room[at])
            room[at] -= sizes[i]
    assert Bins(1, 5).put(5) == (0, 5)


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    path = token_file("piece_bpe_32k.model")
    return PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_pieces_are_the_librarys(pieces):
    model, library = pieces
    letters = ["a", "b", "the", " ", "  ", "\n", "▁", "é", "😀", "ñ", "\t", "1", "23", "\x00", "ing", "<s>", "</s>", "<0x0A>", "Z", "　", "漢", "​", "e", "r", "s", "un", "aaa", "    ", "tion", "str"]
    for text in mixed(letters, 6000, 16):
        ids = library.encode(text)
        assert model.encode(text, add_end=False) == ids, repr(text)
        assert model.decode([*ids, 2]) == library.decode(ids), repr(text)


def test_decoding_any_ids(pieces):
    model, library = pieces
    rng = random.Random(6)
    for _ in range(1500):
        ids = [rng.randrange(3, 32000) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(rng.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids), ids


def test_piece_digests(spark, odd, pieces):
    library = pieces[1]
    got = {r["doc_id"]: r for r in piece_digests(odd).collect()}
    for i, text in enumerate(ODD):
        ids = library.encode(text or "", add_eos=True)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    back = {r["doc_id"]: r["text"] for r in decode_pieces(encode_pieces(odd)).collect()}
    assert back[8] == ODD[8] and back[1] == "" and piece_digests(odd.where("1 = 0")).count() == 0


def test_caches_keep_short_parts_only():
    from evidentia.llm.pieces import KEPT, piece_model

    model = piece_model(token_file("piece_bpe_32k.model"))
    long = "x" * (KEPT * 50)
    model.digest(long), model.encode(long + " y")
    assert all(len(u) <= KEPT for u in model.printed) and all(len(u) <= KEPT for u in model.known)
