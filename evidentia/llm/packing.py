"""Packing token pieces into fixed-size sequences by first-fit decreasing.

Documents are dealt into randomised groups of a bounded expected size and each group is packed
alone. Inside a group a tournament tree over the bins' free room finds the first bin that fits
in a logarithm of the number of bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidentia.llm.common import emit, ship, texts_of
from evidentia.llm.tokens import byte_bpe, token_file

#: Documents that a group holds on average.
GROUP_DOCS = 4096

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("salt", pa.int64())])


class Bins:
    """Bins of one capacity, with a tournament tree whose inner nodes hold the larger free room."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, (max(1, most) - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """The first bin with room for `size` and the room that it had; the bin takes it."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        had = room[at]
        room[at] = had - size
        where = at - self.leaves
        while at > 1:
            at >>= 1
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return where, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, larger sizes first and equal sizes in the given order."""
    bins, where, offset = Bins(len(sizes), capacity), np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        where[i], had = bins.put(int(sizes[i]))
        offset[i] = capacity - had
    return where, offset


def _cut(path: str, length: int, end_id: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, part, row = byte_bpe(path), TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            texts, ids = texts_of(batch.column("text")), batch.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, texts, strict=True):
                data, row = bpe.encode(text) + end, row + 1
                for a in range(0, len(data), 4 * length):
                    piece = memoryview(data)[a : a + 4 * length]
                    for column, value in zip(out, (doc_id, a >> 2, len(piece) >> 2, zlib.crc32(piece), len(data) >> 2, part + row), strict=True):
                        column.append(value)
            yield from emit(_PIECES, out)

    return run


def _pack(length: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("salt", "ascending"), ("start", "ascending")])
        where, offset = first_fit_decreasing(group.column("length").to_numpy(), length)
        number = group.column("group").to_numpy()
        kept = group.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return kept.append_column("sequence_id", pa.array((number << 32) + where)).append_column("offset", pa.array(offset))

    return run


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of at most `length` ids of every document: all but a document's last are full."""
    ship(docs.sparkSession)
    path = tokenizer or token_file("byte_bpe_50k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_cut(path, length, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long")


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = 2048, end_id: int = 1, seed: int = 17) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece.

    A null text is an empty document, which is its end id alone. The group of a document comes
    from a hash of its id and of its place in the input, so repeated ids spread as well. Pieces
    of a sequence lie side by side from offset 0. An empty table gives no rows; other columns
    are ignored.
    """
    pieces = cut_pieces(docs, tokenizer, length, end_id)
    groups = max(1, -(-docs.count() // GROUP_DOCS))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "salt", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(_pack(length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
