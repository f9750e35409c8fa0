"""Hashes, derived ids, canonical JSON and seeded order."""

from __future__ import annotations

import hashlib
import json
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, functions as F


def canonical_json(value: Any) -> str:
    """Sorted keys, no white space, raw characters, ISO dates."""

    def plain(x: Any) -> Any:
        if isinstance(x, (date, datetime)):
            return x.isoformat()
        if isinstance(x, (set, frozenset)):
            return sorted(x)
        raise TypeError(f"{type(x).__name__} has no canonical form")

    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False, default=plain)


def digest(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def sealed(record: dict, exclude: tuple[str, ...] = ("content_hash",)) -> dict:
    """The record with its content hash, which covers everything but the named fields."""
    return record | {"content_hash": digest({k: v for k, v in record.items() if k not in exclude})}


def is_sealed(record: dict, exclude: tuple[str, ...] = ("content_hash",)) -> bool:
    return record.get("content_hash") == sealed(record, exclude)["content_hash"]


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def doc_identity(source: Column, version: Column, text: Column) -> Column:
    """source@version#first 16 digits of the text's hash."""
    return F.concat(source, F.lit("@"), version, F.lit("#"), F.substring(text_hash(text), 1, 16))


def element_identity(kind: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("-", kind, start, end)


def joined_hash(*parts: Column) -> Column:
    """A hash over explicit parts, nulls told apart from empty strings."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def seeded(seed: int | str, name: Column) -> Column:
    """A reproducible random order: the hash of seed and name."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), name.cast("string")), 256)


def fingerprint(rows: Column) -> Column:
    """An order-free digest of an array of structs."""
    return F.sha2(F.to_json(F.array_sort(rows), {"ignoreNullFields": "false"}), 256)
