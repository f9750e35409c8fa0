"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are unit-scaled and turned so that a few leading directions hold most of their spread.
Each label's space is cut at the middle of as many leading directions as its vectors need to fall
into cells of about a tile. Two unit vectors at a cosine of t lie within sqrt(2 - 2t) of each
other, also in the cut directions together; so a vector visits a cell beside its own only if the
distances to the cuts between them stay within that reach jointly, and of two cells only the one
of the larger number is visited. Tile pairs that no cut separates by less are never made.

Cells are cut further into tiles of a bounded number of vectors. A pair of tiles is compared by
the leading directions first; what the rest can add is bounded by the product of the suffix
norms, and pairs that cannot reach the threshold stop there. What is left is confirmed by the
full cosine in double precision.

A pair of tiles gives back counts per vector and the edges of a spanning forest, never all pairs,
and identical vectors are compared once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidentia.llm.common import forget_but, ship, tables, written
from evidentia.operators.components import components

#: Vectors that the directions are fitted on at most, leading directions that are kept, vectors in a tile.
SAMPLE, LEADING, TILE = 5000, 24, 1024

_ROWS = "label string, x array<double>, node long, copies long, size int, cell long, home boolean"


def _bases(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each vector length in a sample of SAMPLE vectors, its LEADING principal directions as columns and the middle along each."""
    rows = vectors.orderBy(F.xxhash64("node", F.lit(31)), "node").limit(SAMPLE).select("x").collect()
    by_size: dict[int, list] = {}
    for row in rows:
        by_size.setdefault(len(row["x"]), []).append(row["x"])
    out = {}
    for size, xs in by_size.items():
        u = _units(np.array(xs))
        _, turn = np.linalg.eigh(np.cov(u.T, bias=True).reshape(size, size) if len(u) > 1 else u.T @ u)
        basis = np.ascontiguousarray(turn[:, ::-1][:, :LEADING])
        out[size] = basis, np.median(u @ basis, axis=0)
    return out


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _visits(gaps: np.ndarray, own: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the cells of larger numbers whose box lies within reach; `gaps` are the rows' signed distances to the cuts.

    Cells differ from a row's own by a set of cuts; the squared distances to these add up, so the
    sets are grown cut by cut as long as the sum allows.
    """
    row, cell, spent = np.arange(len(own)), own.copy(), np.zeros(len(own))
    for i in range(gaps.shape[1]):
        more = spent + gaps[row, i] ** 2
        go = more <= reach * reach
        row, cell, spent = np.concatenate([row, row[go]]), np.concatenate([cell, cell[go] ^ (1 << i)]), np.concatenate([spent, more[go]])
    larger = cell > own[row]
    return row[larger], cell[larger]


def _placed(bases: dict[int, tuple[np.ndarray, np.ndarray]], cuts: int, reach: float, payload: bool):
    """Each vector in its own cell and, as a visitor, in the cells of larger numbers that its links may lie in."""

    def run(batches):
        for batch in batches:
            begins, flat = batch.column("x").offsets.to_numpy(), batch.column("x").values.to_numpy()
            sizes = np.diff(begins)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                x = flat[begins[at][:, None] + np.arange(size)]
                basis, middle = bases.get(size, (np.eye(size)[:, :LEADING], np.zeros(min(size, LEADING))))
                gaps = (_units(x) @ basis - middle)[:, :cuts]
                own = ((gaps > 0) << np.arange(gaps.shape[1])).sum(1).astype(np.int64) if gaps.shape[1] else np.zeros(len(at), np.int64)
                row, cell = _visits(gaps, own, reach)
                rows = batch.take(pa.array(np.concatenate([at, at[row]])))
                home = np.arange(rows.num_rows) < len(at)
                columns = {n: rows.column(n) for n in ("label", "x", "node", "copies")}
                if not payload:
                    columns["x"] = pa.nulls(rows.num_rows, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_pydict({**columns, "size": pa.array(np.full(rows.num_rows, size), pa.int32()), "cell": np.concatenate([own, cell]), "home": home})

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, b) over n nodes, enough to keep the same nodes connected."""
    parent, keep = list(range(n)), []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[x] = y
            keep.append(i)
    return a[keep], b[keep]


def linked_pairs(x: np.ndarray, y: np.ndarray, basis: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of two tiles whose cosine reaches the threshold; with `same`, each unordered pair once."""
    ux, uy = _units(x), _units(y)
    lead_x, lead_y = ux @ basis, uy @ basis
    order_x, order_y = np.argsort(lead_x[:, 0], kind="stable"), np.argsort(lead_y[:, 0], kind="stable")
    out_a, out_b = [], []
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    first_y = lead_y[order_y, 0]
    for at in range(0, len(order_x), 256):
        rows = order_x[at : at + 256]
        lo, hi = np.searchsorted(first_y, [lead_x[rows[0], 0] - reach, lead_x[rows[-1], 0] + reach], side="left")
        columns = order_y[lo:hi]
        if not len(columns):
            continue
        done, sums = 0, np.zeros((len(rows), len(columns)))
        alive = np.ones_like(sums, bool)
        for upto in (4, basis.shape[1]):
            sums += lead_x[rows, done:upto] @ lead_y[columns, done:upto].T
            done = upto
            rest_x = np.sqrt(np.maximum(0, 1 - (lead_x[rows, :done] ** 2).sum(1)))
            rest_y = np.sqrt(np.maximum(0, 1 - (lead_y[columns, :done] ** 2).sum(1)))
            alive = sums + np.outer(rest_x, rest_y) >= threshold - 1e-7
            if not alive.any():
                break
        i, j = np.nonzero(alive)
        i, j = rows[i], columns[j]
        if same:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), 100_000):
            p, q = i[part : part + 100_000], j[part : part + 100_000]
            cosine = np.einsum("ij,ij->i", x[p], y[q]) / (np.linalg.norm(x[p], axis=1) * np.linalg.norm(y[q], axis=1))
            good = cosine >= threshold
            out_a.append(p[good])
            out_b.append(q[good])
    none = np.zeros(0, np.int64)
    return np.concatenate(out_a) if out_a else none, np.concatenate(out_b) if out_b else none


def _compared(bases: dict[int, tuple[np.ndarray, np.ndarray]], threshold: float):
    def run(group: pa.Table) -> pa.Table:
        lists = group.column("x").combine_chunks()
        x = lists.flatten().to_numpy().reshape(len(lists), -1)
        ids, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
        left = group.column("left").to_numpy(zero_copy_only=False)
        basis = bases[x.shape[1]][0] if x.shape[1] in bases else np.eye(x.shape[1])[:, :LEADING]
        same = bool(group.column("same")[0].as_py())
        at_a, at_b = np.flatnonzero(left), np.flatnonzero(left if same else ~left)
        a, b = linked_pairs(x[at_a], x[at_b], basis, threshold, same) if len(at_a) and len(at_b) else (at_a[:0], at_a[:0])
        a, b = at_a[a], at_b[b]
        links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        u, v = _forest(a, b, len(ids))
        held = np.flatnonzero(links)
        return pa.table({"node": np.concatenate([ids[held], ids[u]]), "other": pa.array(np.concatenate([np.zeros(len(held), np.int64), ids[v]]), mask=np.arange(len(held) + len(u)) < len(held)), "links": np.concatenate([links[held].astype(np.int64), np.zeros(len(u), np.int64)])})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Rows are linked when their labels are equal and not null and their cosine is at least
    `threshold`. Vectors that are null, empty or zero, hold null or non-finite components or
    have no id link with nothing: they have no links and are their own component, as are
    vectors of different lengths to each other. Repeated rows are linked like others, and rows
    that share an id but not the label or the vector are told apart. The smallest id of a
    component is kept; an empty table gives no rows; other columns are ignored.
    """
    spark, before = vectors.sparkSession, tables()
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    sound = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0),
        F.lit(False),
    )
    rows = rows.withColumn("sound", sound)
    # -0.0 and 0.0 are one value. Vectors are scaled by a power of two where their squares would leave the doubles.
    clean = F.transform("x", lambda v: v + F.lit(0.0))
    largest = F.array_max(F.transform("x", lambda v: F.abs(v)))
    power = F.pow(F.lit(2.0), -F.floor(F.log2(largest)))
    scaled = F.when((largest > 1e100) | (largest < 1e-100), F.transform(clean, lambda v: v * power)).otherwise(clean)
    classes = rows.where("sound").groupBy("label", scaled.alias("x")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()))
    bases = _bases(classes.select("node", "x"))
    largest_group = classes.groupBy("label", F.size("x")).count().agg(F.max("count")).first()[0] or 0
    cuts = min(LEADING, max(0, int(np.ceil(np.log2(max(1, 2 * largest_group / TILE))))))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9)
    placed = lambda payload: classes.select("label", "x", "node", "copies").mapInArrow(_placed(bases, cuts, reach, payload), _ROWS)
    counts = placed(False).groupBy("label", "size", "cell").agg(*[F.ceil(F.count(F.when(who, 1)) / TILE).cast("int").alias(name) for who, name in ((F.col("home"), "tiles"), (~F.col("home"), "guests"))])
    told = placed(True).join(counts.where("tiles > 0"), ["label", "size", "cell"])
    told = told.withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.when(F.col("home"), F.col("tiles")).otherwise(F.col("guests"))).cast("int"))
    meetings = F.expr("""if(home, concat(
        transform(sequence(0, tiles - 1), t -> named_struct('a', least(t, part), 'guest', false, 'b', greatest(t, part), 'left', part <= t, 'same', t = part)),
        if(guests = 0, array(), transform(sequence(0, guests - 1), t -> named_struct('a', part, 'guest', true, 'b', t, 'left', true, 'same', false)))),
        transform(sequence(0, tiles - 1), t -> named_struct('a', t, 'guest', true, 'b', part, 'left', false, 'same', false)))""")
    met = told.select("label", "size", "cell", "x", "node", "copies", F.explode(meetings).alias("m")).select("label", "size", "cell", "x", "node", "copies", "m.*")
    found = written(met.groupBy("label", "size", "cell", "a", "guest", "b").applyInArrow(_compared(bases, threshold), "node long, other long, links long"))
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.where("other is not null"), "node", "other").select("node", F.col("component").alias("group"))
    forget_but(spark, before, classes, found, groups)
    by_node = classes.join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
    least = by_node.groupBy("group").agg(F.min("rep").alias("component"))
    by_class = by_node.join(least, "group").join(links, "node", "left").select("label", "x", "copies", F.coalesce("links", F.lit(0)).alias("links"), "component")
    keyed = rows.select("vec_id", F.when(F.col("sound"), F.col("label")).alias("label"), F.when(F.col("sound"), scaled).alias("x"))
    out = keyed.join(by_class, ["label", "x"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
