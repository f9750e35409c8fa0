"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are numbered in an order in which neighbours are alike (by the side of the middle on which
they lie along the leading directions of a sample), and a range of numbers forms a block: a
forward index (its ids and integer components) and the least and greatest value of every
component. A query's bound for a block is the sum over its components of the largest product that
the block allows. Blocks are taken in the order of their bounds and scored through their forward
index, until the bounds fall below the k-th best score.

Blocks are gathered into bundles and queries into batches, both of a bounded size. A batch is first
scored against the bundles of its own cell, which gives each query a floor for its k-th score. It
then meets only bundles whose own bound reaches the floor of one of its queries; the pairs are
numbers until then, so what is pruned is never copied. The best k of all are merged by a window
over k rows each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evidentia.llm.common import forget_but, ship, tables, written

#: Vectors in a block, blocks in a bundle, queries in a batch.
BLOCK, BUNDLE, BATCH = 256, 64, 1024
#: Vectors that the order is fitted on at most, directions that it looks at, and bytes of the bundles' extremes that every task may be told.
SAMPLE, DIRECTIONS, TOLD = 5000, 24, 64 << 20
#: Sums of products up to this are exact in double precision.
EXACT = float(2**53)


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and `q`, the components floor(scale * x) with x as double.

    Vectors without an id, null, empty or holding null or non-finite components take no part;
    components that do not fit a long are refused by the cast.
    """
    x = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("q"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of components as a matrix; shorter vectors are filled with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


class Blocks:
    """The blocks of one bundle in its order, for queries of which no component exceeds `largest` in size."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, largest: int, size: int = BLOCK):
        self.ids, self.size = ids, size
        self.starts = np.arange(0, len(ids), size)
        self.least = np.minimum.reduceat(q, self.starts).astype(np.float64)
        self.greatest = np.maximum.reduceat(q, self.starts).astype(np.float64)
        most = float(np.abs(q).max(initial=0)) * float(largest) * max(1, q.shape[1])
        #: Doubles where every partial sum is exact in them, else integers of any size.
        self.kind = np.float64 if most < EXACT else object
        self.q = q.astype(self.kind)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and block, a number that no score in the block exceeds but for rounding."""
        queries = queries.astype(np.float64)
        return np.maximum(queries, 0) @ self.greatest.T + np.minimum(queries, 0) @ self.least.T

    def search(self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The best k (ids, scores) of a query, larger scores first and then smaller ids; rows with its own id are passed over.

        Scores below the floor may be missing.
        """
        ids, scores, query = np.zeros(0, np.int64), np.zeros(0, np.int64), query.astype(self.kind)
        slack = 1e-9 * (np.abs(bounds).max(initial=0.0) + 1)
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] + slack < (max(floor, scores[-1]) if len(scores) == k else floor):
                break
            at = slice(b * self.size, (b + 1) * self.size)
            fresh = (self.q[at] @ query).astype(np.int64)  # a score that no long holds is an error
            taken = np.flatnonzero(fresh >= scores[-1]) if len(scores) == k else np.arange(len(fresh))
            taken = taken[self.ids[at][taken] != query_id]
            if len(taken):
                ids, scores = np.concatenate([ids, self.ids[at][taken]]), np.concatenate([scores, fresh[taken]])
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order], scores[order]
        return ids, scores


def _smallest(q: np.ndarray) -> tuple[str, bytes]:
    """Integers in the narrowest type that holds them all."""
    most = int(np.abs(q).max(initial=0))
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return kind, q.astype(kind).tobytes()


def _packed(group: pa.Table) -> pa.Table:
    """A group's vectors as one row, in the order of their codes, with the extremes of each component."""
    group = group.sort_by([("code", "ascending"), ("vec_id", "ascending")])
    q = _matrix(group.column("q"))
    kind, raw = _smallest(q)
    return pa.table({
        "cell": [group.column("cell")[0].as_py()], "part": [group.column("part")[0].as_py()], "width": [q.shape[1]], "kind": [kind], "ids": [group.column("vec_id").to_numpy().tobytes()], "rows": [group.column("row").to_numpy().tobytes()],
        "q": [raw], "least": [q.min(0).tolist()], "greatest": [q.max(0).tolist()],
    })


_PACKED = "cell long, part long, width long, kind string, ids binary, rows binary, q binary, least array<long>, greatest array<long>"
_FOUND = "query_id long, query_row long, vec_id long, score long"
_NAMES = ["query_id", "query_row", "vec_id", "score"]


def _search(k: int):
    """The best k of each query of a batch in a bundle; `floors`, where there are any, hold for the batch's queries."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for n_row in range(frame.num_rows):
                pair = {c: frame.column(c)[n_row].as_py() for c in frame.schema.names}
                ids, query_ids, rows = (np.frombuffer(pair[c], np.int64) for c in ("ids", "query_ids", "query_rows"))
                q = np.frombuffer(pair["q"], pair["kind"]).reshape(len(ids), pair["width"]).astype(np.int64)
                queries = np.frombuffer(pair["queries"], pair["query_kind"]).reshape(len(query_ids), pair["query_width"]).astype(np.int64)
                floors = np.frombuffer(pair["floors"], np.float64) if pair.get("floors") else np.full(len(query_ids), -np.inf)
                width = max(q.shape[1], queries.shape[1])
                q, queries = _widened(q, width), _widened(queries, width)
                blocks = Blocks(ids, q, int(np.abs(queries).max(initial=0)))
                for at in range(0, len(query_ids), 512):
                    bounds, out = blocks.bounds(queries[at : at + 512]), [[], [], [], []]
                    for n in range(len(bounds)):
                        found, scores = blocks.search(int(query_ids[at + n]), queries[at + n], bounds[n], k, floors[at + n])
                        for column, values in zip(out, (np.full(len(found), query_ids[at + n]), np.full(len(found), rows[at + n]), found, scores), strict=True):
                            column.append(values)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=_NAMES)

    return run


def reached(queries: np.ndarray, floors: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
    """Which bundles, by their components' extremes, may hold a score that reaches the floor of one of the queries."""
    width = max(queries.shape[1], least.shape[1])
    queries, least, greatest = (_widened(m, width).astype(np.float64) for m in (queries, least, greatest))
    out = np.zeros(len(least), bool)
    for at in range(0, len(least), 256):
        bounds = np.maximum(queries, 0) @ greatest[at : at + 256].T + np.minimum(queries, 0) @ least[at : at + 256].T
        out[at : at + 256] = (bounds + 1e-9 * (np.abs(bounds) + 1) >= floors[:, None]).any(0)
    return out


def _meetings(bundles: list[tuple[int, int]], least: np.ndarray, greatest: np.ndarray):
    """(batch, bundle) as numbers for each batch and each bundle of another cell that its floors do not rule out."""
    cells, parts = (np.array(x, np.int64) for x in zip(*bundles, strict=True))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for row in frame.to_pylist():
                queries = np.frombuffer(row["queries"], row["query_kind"]).reshape(-1, row["query_width"])
                hit = reached(queries, np.frombuffer(row["floors"], np.float64), least, greatest) & (cells != row["query_cell"])
                n = int(hit.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["query_cell"])), pa.array(np.full(n, row["query_part"])), pa.array(cells[hit]), pa.array(parts[hit])], names=["query_cell", "query_part", "cell", "part"])

    return run


def _coded(basis: np.ndarray, middle: np.ndarray, bits: int):
    """Adds the code of each vector: the side of the middle on which it lies along each direction, the first one foremost."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            q = _matrix(frame.column("q")).astype(np.float64)
            sides = _widened(q[:, : len(basis)], len(basis)) @ basis > middle if len(basis) else np.zeros((len(q), 0), bool)
            code = (sides[:, :bits].astype(np.int64) << np.arange(min(bits, sides.shape[1]))[::-1]).sum(1)
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(code.astype(np.int64))], names=[*frame.schema.names, "code"])

    return run


def _fitted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Leading directions of a sample of SAMPLE vectors, and the middle along each."""
    sample = [r["q"] for r in rows.orderBy(F.xxhash64("row", F.lit(41)), "row").limit(SAMPLE).select("q").collect()]
    width = max(map(len, sample), default=0)
    q = np.array([[*x, *[0] * (width - len(x))] for x in sample], np.float64).reshape(len(sample), width)
    if not q.size:
        return np.zeros((0, 0)), np.zeros(0)
    _, turn = np.linalg.eigh(np.atleast_2d(np.cov(q.T, bias=True)))
    basis = np.ascontiguousarray(turn[:, ::-1][:, :DIRECTIONS])
    return basis, np.median(q @ basis, axis=0)


def _dealt(rows: DataFrame, most: int) -> DataFrame:
    """Each cell's rows in groups of about `most` at most, each as one row."""
    parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / most).alias("parts"))
    told = rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("row", F.lit(7)), F.col("parts")))
    return told.drop("parts").groupBy("cell", "part").applyInArrow(_packed, _PACKED)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose id is divisible by `every`, the k best of all other rows.

    Ties go to the smaller vec_id. Rows that share the query's id count as its own. Repeated
    rows are candidates each, and a repeated query row is answered each time. Vectors of
    different lengths meet as if the shorter ended in zeros. Fewer candidates give fewer rows,
    an empty table none; other columns, labels included, are ignored.
    """
    spark, before = vectors.sparkSession, tables()
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(quantised(vectors, scale).withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    basis, middle = _fitted(rows)
    bits = min(DIRECTIONS, max(0, int(np.ceil(np.log2(max(1, n / BLOCK))))), basis.shape[1])
    coarse = min(bits, max(0, int(np.ceil(np.log2(max(1, n / (BLOCK * BUNDLE)))))))
    coded = rows.mapInArrow(_coded(basis, middle, bits), "vec_id long, q array<long>, row long, code long").withColumn("cell", F.shiftright("code", bits - coarse))
    bundles = written(_dealt(coded, BLOCK * BUNDLE))
    batches = _dealt(coded.where(F.col("vec_id") % every == 0), BATCH)
    batches = written(batches.select(F.col("cell").alias("query_cell"), F.col("part").alias("query_part"), F.col("width").alias("query_width"), F.col("kind").alias("query_kind"), F.col("ids").alias("query_ids"), F.col("rows").alias("query_rows"), F.col("q").alias("queries")))
    payload = bundles.select("cell", "part", "width", "kind", "ids", "q")
    own = batches.join(payload, F.col("cell") == F.col("query_cell")).repartition(parts, "query_cell", "query_part", "part")
    found = written(own.mapInArrow(_search(k), _FOUND))
    told = bundles.select("cell", "part", "least", "greatest")
    size = told.agg(F.count("*").alias("n"), F.coalesce(F.max("part"), F.lit(0)), F.coalesce(F.sum(16 * F.size("least")), F.lit(0)).alias("bytes"), F.count_distinct("cell").alias("cells")).first()
    if size["cells"] > 1:
        floors = found.groupBy("query_id", "query_row").agg(F.when(F.count("*") >= k, F.element_at(F.sort_array(F.collect_list("score"), asc=False), k)).alias("floor")).where("floor is not null")
        asked = _with_floors(batches, floors)
        if size["bytes"] <= TOLD:
            meta = told.collect()
            width = max(len(r["least"]) for r in meta)
            extremes = [np.array([[*r[c], *[0] * (width - len(r[c]))] for r in meta], np.int64) for c in ("least", "greatest")]
            pairs = asked.mapInArrow(_meetings([(r["cell"], r["part"]) for r in meta], *extremes), "query_cell long, query_part long, cell long, part long")
        else:  # too many to tell: all pairs of numbers of other cells, still without their payloads
            every_one = told.agg(F.collect_list(F.struct("cell", "part")).alias("all"))
            pairs = asked.select("query_cell", "query_part").crossJoin(every_one).select("query_cell", "query_part", F.inline("all")).where("cell <> query_cell")
        met = pairs.join(asked, ["query_cell", "query_part"]).join(payload, ["cell", "part"]).repartition(parts, "query_cell", "query_part", "cell", "part")
        more = written(met.mapInArrow(_search(k), _FOUND))
        forget_but(spark, before, found, more)
        found = found.unionByName(more)
    else:
        forget_but(spark, before, found)
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _with_floors(batches: DataFrame, floors: DataFrame) -> DataFrame:
    """Batches with their queries' floors as packed doubles, in the order of the queries."""

    def places(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for row in frame.to_pylist():
                rows = np.frombuffer(row["query_rows"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), row["query_cell"])), pa.array(np.full(len(rows), row["query_part"])), pa.array(np.arange(len(rows))), pa.array(rows)], names=["query_cell", "query_part", "place", "query_row"])

    def packed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            values = [np.array([-np.inf if x["floor"] is None else x["floor"] for x in sorted(row, key=lambda x: x["place"])], np.float64).tobytes() for row in frame.column("held").to_pylist()]
            yield pa.RecordBatch.from_arrays([frame.column("query_cell"), frame.column("query_part"), pa.array(values, pa.binary())], names=["query_cell", "query_part", "floors"])

    at = batches.select("query_cell", "query_part", "query_rows").mapInArrow(places, "query_cell long, query_part long, place long, query_row long")
    held = at.join(floors.select("query_row", "floor"), "query_row", "left").groupBy("query_cell", "query_part").agg(F.collect_list(F.struct("place", "floor")).alias("held"))
    return batches.join(held.mapInArrow(packed, "query_cell long, query_part long, floors binary"), ["query_cell", "query_part"])
