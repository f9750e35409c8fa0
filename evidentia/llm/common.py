"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evidentia.session import bucketed, forget, forget_but, ship, table, tables, written  # noqa: F401  (used by the operators)

#: Multiplier of the polynomial hashes; odd, so that it is a unit modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are hashed at once. Positions enter a hash relative to this size, so it is a constant.
PIECE = 1 << 20

_powers: np.ndarray | None = None


def powers() -> np.ndarray:
    """BASE**0 .. BASE**PIECE modulo 2**64, made once in each worker."""
    global _powers
    if _powers is None:
        with np.errstate(over="ignore"):
            p = np.full(PIECE + 1, BASE, np.uint64)
            p[0] = 1
            _powers = np.cumprod(p)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums over at most PIECE bytes, for span_hash()."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers()[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end), the same wherever in a piece they lie."""
    return mix((prefix[end] - prefix[start]) * powers()[PIECE - start])


def texts_of(column: pa.Array) -> list[str]:
    """The strings of an Arrow column, '' for null."""
    return ["" if x is None else x for x in column.to_pylist()]


def byte_rows(column: pa.Array) -> list[memoryview]:
    """The UTF-8 bytes of each string of an Arrow column without copies, empty for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2] or b"")
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [data[a:b] if v else data[:0] for a, b, v in zip(offsets[:-1].tolist(), offsets[1:].tolist(), valid.tolist(), strict=True)]


def emit(schema: pa.Schema, columns: Iterable, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Columns as record batches of a bounded number of rows."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    whole = pa.RecordBatch.from_arrays(arrays, schema=schema)
    for at in range(0, whole.num_rows, size):
        yield whole.slice(at, size)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal integer keys, and where their runs start, from batches that are sorted by the keys.

    Only the unfinished run at the end of a batch is held back, so a task holds one batch and one run.
    """
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        columns = [table.column(k).to_numpy() for k in keys]
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(held[0].column(k)[0].as_py() == batch.column(k)[batch.num_rows - 1].as_py() for k in keys):
            held.append(batch)
            continue
        whole = pa.Table.from_batches([*held, batch])
        first = starts(whole)
        if len(first) > 1:
            yield whole.slice(0, int(first[-1])), first[:-1]
        held = whole.slice(int(first[-1])).combine_chunks().to_batches()
    if held:
        whole = pa.Table.from_batches(held)
        yield whole, starts(whole)


def sorted_runs(rows: DataFrame, keys: list[str], function, schema: str, order: list[str] | None = None) -> DataFrame:
    """The function over each partition's batches, with all rows of a key in one partition and sorted by the keys and the order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(function, schema)
