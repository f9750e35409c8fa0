"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Only SQL functions are used. Row numbers come from windows inside a fixed number of hash ranges
plus the ranges' offsets, so no step puts all rows into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Hash ranges that rows are numbered in; the table of their offsets has this many rows at most.
RANGES = 4096
ROUNDS = 6
#: Steps of a walk that are written out. A walk leaves the surplus with a chance of at least 1 - 2/sqrt(n) at each step.
WALK = 64


def _permute(x: str, n: str, seed: int) -> str:
    """SQL for one pass of the network over 0 .. a*b-1, where a = ceil(sqrt(n)) and b = ceil(n/a)."""
    a, b = f"cast(ceil(sqrt({n})) as bigint)", f"cast(ceil({n} / ceil(sqrt({n}))) as bigint)"
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', {x} % {a}, 'r', {x} div {a}), (s, k) -> "
        f"if(k % 2 = 0, named_struct('l', (s.l + pmod(xxhash64(s.r, k, {seed}L), {a})) % {a}, 'r', s.r), "
        f"named_struct('l', s.l, 'r', (s.r + pmod(xxhash64(s.l, k, {seed}L), {b})) % {b})), s -> s.r * {a} + s.l)"
    )


def permuted(x: str, n: str, seed: int) -> str:
    """SQL for the place of row number x among n rows: a bijection of 0 .. n-1.

    The network permutes a slightly larger range; values in the surplus are put through it again
    until they fall below n. A walk longer than WALK steps is an error, not a wrong place.
    """
    walk = f"aggregate(sequence(1, {WALK}), {_permute(x, n, seed)}, (v, i) -> if(v < {n}, v, {_permute('v', n, seed)}))"
    return f"aggregate(array({walk}), 0L, (z, v) -> if(v < {n}, v, cast(raise_error('the walk did not end') as bigint)))"


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Every row with a global `row_number` from 0 and the total `n`; rows with equal keys are interchangeable.

    Equal rows are counted before any shuffle and spread out again at the end, so a key that
    holds a third of all rows costs one row until then.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(RANGES)).cast("int")
    groups = rows.groupBy(*keys).agg(F.count("*").alias("__copies")).withColumn("__bucket", bucket)
    totals = groups.groupBy("__bucket").agg(F.sum("__copies").alias("__rows"))
    everything = Window.orderBy("__bucket")
    offsets = totals.select(
        "__bucket",
        (F.sum("__rows").over(everything) - F.col("__rows")).alias("__before"),
        F.sum("__rows").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"),
    )
    within = Window.partitionBy("__bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = groups.withColumn("__first", F.sum("__copies").over(within) - F.col("__copies"))
    placed = first.join(F.broadcast(offsets), "__bucket", "left").withColumn("__first", F.col("__before") + F.col("__first"))
    return placed.select(*keys, "n", F.explode(F.expr("sequence(__first, __first + __copies - 1)")).alias("row_number"))


def shard(rows: DataFrame, keys: list[str], n_shards: int, seed: int = 17) -> DataFrame:
    """Rows with row_number, place, shard and slot.

    The place of a row is the permutation of its row number; shard = place mod n_shards and
    slot = place div n_shards, so shard sizes differ by one row at most, slots have no gaps, and
    both follow from the row number alone. The same rows and seed give the same result on any
    cluster. An empty table gives no rows; nulls in the keys are values like others.
    """
    out = numbered(rows, keys).withColumn("place", F.expr(permuted("row_number", "n", seed)))
    return out.withColumns({"shard": (F.col("place") % n_shards).cast("int"), "slot": F.expr(f"place div {n_shards}")})


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = 17) -> DataFrame:
    """Documents by the law `rows`: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 length of the text plus 16; a null text has no bytes. Rows that agree in
    doc_id, size and checksum are interchangeable. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    out = shard(rows, ["doc_id", "size", "text_crc32"], n_shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
