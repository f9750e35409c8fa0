"""Merge-type piece encoding from a prefix table, and decoding.

A merge-type model joins, again and again, the neighbouring pair whose union has the best score.
Every prefix of a text then has one encoding, and cutting an encoding anywhere leaves encodings.
So it is enough to know each prefix's last token: among the tokens that an automaton finds to
end there, it is the one that may stand behind the last token of the rest. Which pairs may stand
together is found by merging the pair's own text. The ids come from walking the table backwards.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidentia.llm.common import emit, ship, texts_of
from evidentia.llm.tokens import token_file

SPACE = "▁"
#: Entries that each of a worker's caches holds before it is begun anew, and characters of the longest part that it keeps.
CACHE, KEPT = 500_000, 64
#: Tested pairs that a worker remembers.
PAIRS = 1_000_000

_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_loaded: dict[str, "PieceModel"] = {}


class PieceModel:
    """The pieces of one model file, with the tables for encoding and decoding."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or norm.name != "identity" or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only merge-type models without normalisation are supported")
        if any(p.type == _USER for p in model.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        self.dummy = SPACE if norm.add_dummy_prefix else ""
        self.end = next(i for i, p in enumerate(model.pieces) if p.piece == (model.trainer_spec.eos_piece or "</s>"))
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == _UNKNOWN)
        self.unknown_surface = model.trainer_spec.unk_surface
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        self.byte_ids = [0] * 256
        self.surface: list[bytes] = []
        self.many = len(model.pieces)
        for i, p in enumerate(model.pieces):
            if p.type == _BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.surface.append(bytes([int(p.piece[1:-1], 16)]))
            elif p.type == _NORMAL:
                self.surface.append(p.piece.replace(SPACE, " ").encode())
            else:
                self.surface.append(b"" if p.type == _CONTROL else self.unknown_surface.encode())
        self.fallback = model.trainer_spec.byte_fallback
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        #: Where a text may be cut beforehand: no piece has a space behind another character, and line feeds are in no longer piece.
        spaced = any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        lined = any("\n" in p and len(p) > 1 for p in self.id_of)
        self.units = None if spaced else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if lined else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n").findall
        self.text = [p.piece for p in model.pieces]
        self.size = [len(p.piece) for p in model.pieces]
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.printed = _Printed(self)

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text by the merges themselves: best score first, then leftmost."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def together(self, left: str, right: str) -> bool:
        """Whether the tokens may be neighbours: merging their joint text gives back the two."""
        return self.merged(left + right) == [left, right]

    def table(self, text: str) -> list[int]:
        """For each prefix, the last token of its encoding: an id, or -1 - code point for a character in no piece."""
        last: list[int | None] = [None] * (len(text) + 1)
        done, pairs, alone = 0, self.pairs, self.alone
        for end, token in self.automaton.iter(text):
            at = end + 1
            if last[at] is not None:
                continue
            while done < end:  # prefixes that no piece ends
                done += 1
                if last[done] is None:
                    last[done] = -1 - ord(text[done - 1])
            before = at - self.size[token]
            if before:
                pair = last[before] * self.many + token
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) > PAIRS:
                        pairs.clear()
                    left = last[before]
                    fits = pairs[pair] = self.together(self.text[left] if left >= 0 else chr(-1 - left), self.text[token])
            else:
                fits = alone.get(token)
                if fits is None:
                    fits = alone[token] = self.merged(self.text[token]) == [self.text[token]]
            if fits:
                last[at] = token
        for at in range(done + 1, len(text) + 1):
            if last[at] is None:
                last[at] = -1 - ord(text[at - 1])
        return last

    def unit_ids(self, unit: str) -> tuple[int, ...]:
        """The ids of a unit, recovered backwards from its prefix table."""
        out: list[int] = []
        last, at = self.table(unit), len(unit)
        while at:
            token = last[at]
            if token >= 0:
                out.append(token)
                at -= self.size[token]
            else:
                out += [self.byte_ids[b] for b in reversed(chr(-1 - token).encode())] if self.fallback else [self.unknown]
                at -= 1
        out.reverse()
        return tuple(out)

    def units_of(self, text: str) -> list[str]:
        """The parts of the escaped text that no token can span."""
        if not text:
            return []
        escaped = self.dummy + text.replace(" ", SPACE)
        return self.units(escaped) if self.units else [escaped]

    def encode(self, text: str, add_end: bool = True) -> list[int]:
        """The ids of a text."""
        out: list[int] = []
        for unit in self.units_of(text):
            ids = self.known.get(unit)
            if ids is None:
                if len(self.known) > CACHE:
                    self.known.clear()
                ids = self.unit_ids(unit)
                if len(unit) <= KEPT:
                    self.known[unit] = ids
            out += ids
        return [*out, self.end] if add_end else out

    def surfaces(self, ids) -> bytes:
        """The bytes that the pieces stand for, before the dummy space is taken off."""
        return b"".join([self.surface[i] for i in ids])

    def decode(self, ids) -> str:
        """The text of ids; broken byte sequences become U+FFFD, one for each bad byte."""
        first = next((self.text[i] for i in ids if self.surface[i]), "")
        return self.finish(self.surfaces(ids), first.startswith(SPACE))

    def finish(self, data: bytes, spaced: bool) -> str:
        """Text from the pieces' bytes without the dummy space, if the first piece has one."""
        return (data[1:] if self.dummy and spaced else data).decode("utf-8", "each_bad_byte")

    def digest(self, text: str) -> tuple[int, str, str]:
        """The number of ids with the end id, the SHA-256 of the printed ids and that of the decoded text."""
        units, printed = self.units_of(text), self.printed
        if not units:
            return 1, hashlib.sha256(str(self.end).encode()).hexdigest(), hashlib.sha256(b"").hexdigest()
        if len(printed) > CACHE:
            printed.clear()
        lines, sizes, surfaces = zip(*map(printed.__getitem__, units), strict=True)
        line = " ".join([*lines, str(self.end)])
        decoded = self.finish(b"".join(surfaces), lines[0] and units[0].startswith(SPACE))
        return sum(sizes) + 1, hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


class _Printed(dict):
    """Of each unit: its ids as text, how many they are, and the bytes that they stand for."""

    def __init__(self, model: PieceModel):
        self.model = model

    def __missing__(self, unit: str) -> tuple[str, int, bytes]:
        ids = self.model.unit_ids(unit)
        found = " ".join(map(str, ids)), len(ids), self.model.surfaces(ids)
        if len(unit) <= KEPT:
            self[unit] = found
        return found


codecs.register_error("each_bad_byte", lambda e: ("\ufffd", e.start + 1))


def piece_model(path: str) -> PieceModel:
    """The model of a file, loaded once in each worker."""
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _model(model: str | None) -> str:
    return model or token_file("piece_bpe_32k.model")


def encode_pieces(docs: DataFrame, model: str | None = None, add_end: bool = True) -> DataFrame:
    """doc_id and `ids`, an array of ints, of every whole text; null texts count as empty."""
    ship(docs.sparkSession)
    path = _model(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [piece_model(path).encode(t, add_end) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and `text` from an `ids` column; null ids give an empty text."""
    ship(encoded.sparkSession)
    path = _model(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [piece_model(path).decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def piece_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text with an end id.

    A null text counts as empty and has the end id alone. Each row of a repeated document is
    encoded. Parts of a text that no token can span are encoded once and kept in a bounded cache.
    Other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    path = _model(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [piece_model(path).digest(t) for t in texts_of(batch.column("text"))]
            columns = list(zip(*found, strict=True)) if found else [[], [], []]
            yield from emit(_DIGESTS, [batch.column("doc_id"), *columns])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
