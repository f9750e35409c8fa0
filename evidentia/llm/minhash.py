"""Near-duplicate documents by a signature-coordinate inverted join.

Documents with the same set of word shingles form a class; one of each class goes on. A class's
MinHash signature is posted under the (coordinate, value) pairs of a prefix of its coordinates:
two signatures that agree in at least m of COORDINATES must share one of the first
COORDINATES - m + 1, where m follows from the similarity asked for (see `agreeing`). Values that very many classes have, such as those of a common passage,
are left out of the count: the same holds for the first as many others. Inside a posting list, classes that cannot collect enough collisions
with the others at all are skipped; the rest are merged from one to the next, counting the
collisions, and those above the threshold are joined by the edges of a spanning forest.
A long list is dealt into cells of a bounded size, each with the list's least class besides its
own: what a cell connects with that class is connected in the whole list, and only the rest
meets all others, in a grid of cells.

The forests' components are small groups of candidates. Inside each group the links are
confirmed on the full shingle sets, large groups dealt into cells in the same way, and again only
a spanning forest leaves a task. No pairs of a group are ever written out, and no list, group or
set is gathered on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidentia.llm.common import PIECE, byte_rows, emit, forget_but, mix, prefix_hash, ship, sorted_runs, span_hash, tables, whole_runs, written
from evidentia.operators.components import components

WORDS = 5
#: Coordinates of a signature, and the share of pairs at the asked similarity that may agree in too few of them to be candidates.
COORDINATES, MISSED = 64, 1e-5


def agreeing(percent: int) -> int:
    """Agreeing coordinates that a candidate needs: the most that pairs at `percent` miss in at most MISSED of cases; 41 at 85, 36 at 80."""
    s, below, m = percent / 100, 0.0, 0
    while m < COORDINATES and (below := below + comb(COORDINATES, m) * s**m * (1 - s) ** (COORDINATES - m)) <= MISSED:
        m += 1
    return max(1, m)


MATCHES = agreeing(85)
#: Entries of a posting list in one cell; classes and shingles of a candidate group in one cell, and classes where its leader is in each cell.
LIST, GROUP, SHINGLES, STAR = 1024, 512, 500_000, 64
#: Rows of a list up to which all are compared at once, without looking for rows to skip.
FEW = 32

#: Classes that frequent values are looked for in, times that a value must occur among them at least to be called frequent, and classes that have it then.
SAMPLE, LEAST, OFTEN = 50_000, 64, 8192

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MULTIPLIERS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of lower-cased bytes, in order; any length of text, whole pieces at a time."""
    found, at = [], 0
    while at < len(data):
        upto = min(len(data), at + PIECE)
        if upto < len(data):  # never cut inside a word
            gaps = np.flatnonzero(_SPACE[data[at:upto]])
            if len(gaps):
                upto = at + int(gaps[-1]) + 1
            else:  # a word longer than a piece is hashed by its own digest
                rest = np.flatnonzero(_SPACE[data[upto:]])
                upto = upto + int(rest[0]) if len(rest) else len(data)
                digest = hashlib.blake2b(_LOWER[data[at:upto]].tobytes(), digest_size=8).digest()
                found.append(np.frombuffer(digest, np.uint64))
                at = upto
                continue
        part = _LOWER[data[at:upto]]
        inside = np.concatenate([[False], ~_SPACE[part], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        found.append(span_hash(prefix_hash(part), edges[0::2], edges[1::2]))
        at = upto
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _combine(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words."""
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + words[i : len(words) - n + 1 + i]
    return mix(out ^ np.uint64(n))


def shingles(data: np.ndarray) -> np.ndarray:
    """The sorted distinct shingle hashes of a text: runs of five words, or all words where they are fewer."""
    words = word_hashes(data)
    if not len(words):
        return words
    return np.unique(_combine(words, min(WORDS, len(words))))


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures of non-empty sets, one row of 32-bit coordinates each."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    flat = np.concatenate(sets)
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k, m in enumerate(_MULTIPLIERS):
        out[:, k] = np.minimum.reduceat(flat * m, starts) >> np.uint64(32)
    return out


_CLASSED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("class", pa.binary()), ("n_shingles", pa.int64()), ("signature", pa.binary())])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document: its id, the digest of its set, the set's size and its signature (null for an empty set)."""
    for batch in batches:
        ids, keys, rows = batch.column("doc_id"), batch.column("text_key"), byte_rows(batch.column("text"))
        at = 0
        while at < len(rows):
            upto, size = at, 0
            while upto < len(rows) and (upto == at or size + len(rows[upto]) <= PIECE):
                size, upto = size + len(rows[upto]), upto + 1
            sets = [shingles(np.frombuffer(r, np.uint8)) for r in rows[at:upto]]
            full = [s for s in sets if len(s)]
            sketches = iter(signature(full)) if full else iter(())
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield from emit(_CLASSED, [ids.slice(at, upto - at), keys.slice(at, upto - at), digests, [len(s) for s in sets], [next(sketches).tobytes() if len(s) else None for s in sets]])
            at = upto


def connected(signatures: np.ndarray, matches: int = MATCHES) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) of a spanning forest of the rows that agree in at least `matches` coordinates.

    A row that shares fewer than `matches` of its coordinates with any other row at all is skipped
    first. The others are visited from neighbour to neighbour, and a row once reached is not
    compared with later ones.
    """
    alive = np.arange(len(signatures))
    while len(alive) > FEW:
        shared = np.zeros(len(alive), np.int32)
        for k in range(COORDINATES):
            _, inverse, counts = np.unique(signatures[alive, k], return_inverse=True, return_counts=True)
            shared += counts[inverse] > 1
        keep = shared >= matches
        if keep.all():
            break
        alive = alive[keep]
    a, b = [], []
    rest = alive
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            hits = (signatures[rest] == signatures[node]).sum(1) >= matches
            if hits.any():
                new = rest[hits].tolist()
                a += [node] * len(new)
                b += new
                queue += new
                rest = rest[~hits]
    return np.array(a, np.int64), np.array(b, np.int64)


def posting_hashes(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each coordinate and its value."""
    return mix(signatures.astype(np.uint64) | (np.arange(1, COORDINATES + 1, dtype=np.uint64) << np.uint64(32)))


def postings(signatures: np.ndarray, frequent: np.ndarray, matches: int = MATCHES) -> tuple[np.ndarray, np.ndarray]:
    """(row, posting) under which signatures are found, for a set of frequent hashes.

    Whatever that set is, two rows that agree in `matches` coordinates share a posting. If f of a
    row's coordinates are frequent, agreeing rows share matches - f others at least, so the first
    of these is among the row's first COORDINATES - matches + 1 others, the prefix. Rows with
    f >= matches may share frequent values alone: they also go under the frequent ones of their
    prefix of all coordinates, in lists of their own.
    """
    prefix = COORDINATES - matches + 1
    hashes = posting_hashes(signatures)
    often = np.isin(hashes, frequent) if len(frequent) else np.zeros(hashes.shape, bool)
    taken = ~often & (np.cumsum(~often, axis=1) <= prefix)
    row, column = np.nonzero(taken)
    found = hashes[row, column]
    dense = np.flatnonzero(often.sum(1) >= matches)
    if len(dense):
        r, c = np.nonzero(often[dense, :prefix])
        row, found = np.concatenate([row, dense[r]]), np.concatenate([found, mix(hashes[dense[r], c] ^ np.uint64(0x5DEECE66D))])
    return row, found


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _posted(frequent: np.ndarray, matches: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = postings(_matrix(batch.column("signature")), frequent, matches)
            yield from emit(_POSTED, [batch.column("node").to_numpy()[row], found.view(np.int64)])

    return run


def _valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(posting_hashes(_matrix(batch.column("signature"))).view(np.int64).ravel())], names=["value"])


def frequent_values(classes: DataFrame, n: int) -> np.ndarray:
    """Hashes that more than about OFTEN classes have, judged by a sample of SAMPLE classes at most; so there are 64 * SAMPLE / LEAST of them at most."""
    share = min(1.0, SAMPLE / max(1, n))
    sampled = classes if share == 1.0 else classes.where(F.pmod(F.xxhash64("node", F.lit(17)), F.lit(1_000_000)) < int(share * 1_000_000))
    counts = sampled.select("signature").mapInArrow(_valued, "value long").groupBy("value").count()
    rows = counts.where(F.col("count") > max(LEAST, int(OFTEN * share))).select("value").collect()
    return np.sort(np.array([r["value"] for r in rows], np.int64).view(np.uint64))


_POSTED = pa.schema([("node", pa.int64()), ("key", pa.int64())])


_LINKED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])


def _within(links, payload: str, decoded, pairs=None):
    """Edges inside each cell of rows; and, as rows without `b`, the nodes of a first grid's cell that its leader does not reach.

    The rows of a cell come sorted by key, cell and node. `links` gives the edges (by place) of a
    spanning forest of some decoded payloads; `pairs` tells for many neighbours at once whether
    they are linked, for cells of two. A node that is its key's leader is marked by `lead`; only in
    lists of several cells there is one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_runs(batches, ["key", "across", "along"]):
            key, node, lead = table.column("key").to_numpy(), table.column("node").to_numpy(), table.column("lead").to_numpy() > 0
            rows = decoded(table.column(payload).to_pylist())
            ends = np.append(starts[1:], len(node))
            out: list[list[np.ndarray]] = [[node[:0]], [node[:0]], [node[:0]]]
            many = ends - starts > 1
            if pairs is not None:
                two = (ends - starts == 2) & ~lead[starts] & ~lead[ends - 1]
                many &= ~two
                at = starts[two]
                hit = at[(node[at] != node[at + 1]) & pairs(rows, at)]
                for column, values in zip(out, (node[hit], node[hit + 1], np.zeros(len(hit), np.int64)), strict=True):
                    column.append(values)
            for i, j in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
                own, first = np.unique(node[i:j], return_index=True)
                if len(own) == 1:
                    continue
                a, b = links(rows[i:j] if len(own) == j - i else [rows[i + f] for f in first.tolist()])
                led = lead[i:j][first]
                rest = own[~_reached(int(np.flatnonzero(led)[0]), a, b, len(own))] if led.any() else own[:0]
                for column, values in zip(out, (np.append(own[a], rest), np.append(own[b], np.full(len(rest), -1)), np.full(len(a) + len(rest), key[i])), strict=True):
                    column.append(values)
            a, b, k = map(np.concatenate, out)
            if len(a):
                yield from emit(_LINKED, [a, pa.array(b, mask=b < 0), k])

    return run


def _reached(start: int, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of n places the edges connect with the one to start from."""
    mark = np.zeros(n, bool)
    mark[start] = True
    while True:
        hit = mark[a] != mark[b]
        if not hit.any():
            return mark
        mark[a[hit]] = mark[b[hit]] = True


def _connected_in_cells(rows: DataFrame, sizes: DataFrame, payload: DataFrame, name: str, function) -> DataFrame:
    """Edges (a, b) that connect within each key all nodes that links connect.

    `rows` has key and node, `payload` what is compared of each node. `sizes` has, for each key of
    two nodes or more, its size (of nodes), its leader (one of them), the number of its cells and
    of the coarser ones of a grid. In lists of several cells the leader is in each. Nodes that
    their cell does not connect with it meet all nodes of the list in a grid, across by themselves
    and along with the others.
    """
    spread = lambda salt, into: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(into)).cast("int")
    every = lambda into: F.sequence(F.lit(0), F.col(into) - 1)
    columns = ["key", "across", "along", "node", "lead"]
    dealt = rows.join(sizes, "key").withColumn("lead", ((F.col("cells") > 1) & (F.col("node") == F.col("leader"))).cast("int"))
    dealt = dealt.withColumn("along", F.explode(F.when(F.col("lead") > 0, every("cells")).otherwise(F.array(spread(7, "cells"))))).withColumn("across", F.lit(0))
    schema = "a long, b long, key long"
    compared = lambda cells: sorted_runs(cells.select(*columns).join(payload.hint("merge"), "node").select(*columns, name), ["key", "across", "along"], function, schema, ["node"])
    first = written(compared(dealt))
    rest = first.where("b is null").select("key", F.col("a").alias("node"))
    if rest.isEmpty():
        return first.select("a", "b")
    left = rest.groupBy("key").agg(F.count("*").alias("n")).join(sizes.select("key", "coarse", "size"), "key")
    left = left.select("key", "coarse", F.ceil(F.col("n") * F.col("coarse") / F.col("size")).cast("int").alias("rows"), F.lit(0).alias("lead"))
    along = rows.join(left, "key").withColumns({"along": spread(7, "coarse"), "across": F.explode(every("rows"))})
    across = rest.join(left, "key").withColumns({"across": spread(13, "rows"), "along": F.explode(every("coarse"))})
    return first.where("b is not null").select("a", "b").unionByName(compared(along.select(*columns).unionByName(across.select(*columns))).select("a", "b"))


def alike(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges, by place, of a spanning forest of the sets for which 100 * |intersection| >= percent * |union|."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(codes.max(initial=-1)) + 1, bool)
    a, b, rest = [], [], np.arange(len(sets))
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            near = rest[100 * np.minimum(sizes[rest], sizes[node]) >= percent * np.maximum(sizes[rest], sizes[node])]
            if not len(near):
                continue
            own = codes[starts[node] : starts[node + 1]]
            mark[own] = True
            lengths = sizes[near]
            ends = np.cumsum(lengths)
            at = np.arange(ends[-1]) + np.repeat(starts[near] - (ends - lengths), lengths)
            common = np.add.reduceat(mark[codes[at]].astype(np.int64), ends - lengths)
            mark[own] = False
            hits = near[100 * common >= percent * (lengths + sizes[node] - common)]
            if len(hits):
                a += [node] * len(hits)
                b += hits.tolist()
                queue += hits.tolist()
                rest = np.setdiff1d(rest, hits, assume_unique=True)
    return np.array(a, np.int64), np.array(b, np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(np.frombuffer(r, np.uint8)).tobytes() for r in byte_rows(batch.column("text"))]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sets, pa.binary())], names=[*names, "shingles"])


def classes_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, class (digest of the shingle set), n_shingles and signature of every row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("text_key", F.xxhash64("text")).mapInArrow(_sketched, "doc_id long, text_key long, class binary, n_shingles long, signature binary")


def _classes(classed: DataFrame) -> DataFrame:
    """One row per distinct set, with the row that stands for it and a number of its own."""
    classes = classed.where("class is not null and doc_id is not null").groupBy("class").agg(
        F.min("doc_id").alias("rep"), F.min_by("text_key", "doc_id").alias("text_key"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")
    )
    return written(classes.withColumn("node", F.monotonically_increasing_id()))


def _candidate_groups(classes: DataFrame, matches: int) -> DataFrame:
    """(node, candidates): classes whose signatures are connected by enough agreeing coordinates."""
    frequent = frequent_values(classes, classes.count())
    posted = classes.select("node", "signature").mapInArrow(_posted(frequent, matches), "node long, key long")
    sizes = posted.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("leader")).where("size > 1").withColumn("cells", F.ceil(F.col("size") / LIST).cast("int")).withColumn("coarse", F.col("cells"))
    links = _within(
        lambda found: connected(np.asarray(found), matches), "signature", lambda raw: np.frombuffer(b"".join(raw), np.uint32).reshape(-1, COORDINATES),
        lambda found, at: (found[at] == found[at + 1]).sum(1) >= matches,
    )
    edges = _connected_in_cells(posted, sizes, classes.select("node", "signature"), "signature", links)
    return components(edges).select("node", F.col("component").alias("candidates"))


def _linked(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(node, component) by links that are confirmed on the full sets of the candidates' texts."""
    rows = members.select(F.col("candidates").alias("key"), "node")
    sizes = members.groupBy(F.col("candidates").alias("key")).agg(F.sum("n_shingles").alias("size"), F.min("node").alias("leader"), F.count("*").alias("nodes"))
    cells = lambda most: F.least(F.greatest(F.ceil(F.col("size") / SHINGLES), F.ceil(F.col("nodes") / most)), F.col("nodes")).cast("int")
    sizes = sizes.where("nodes > 1").select("key", F.col("nodes").alias("size"), "leader", cells(STAR).alias("cells"), cells(GROUP).alias("coarse"))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    told = texts.join(members.select("node", "rep", "text_key").hint("merge"), "rep").where(F.xxhash64("text") == F.col("text_key")).dropDuplicates(["node"])
    sets = written(told.select("node", "text").mapInArrow(_sets, "node long, shingles binary"))
    links = _within(lambda found: alike(found, percent), "shingles", lambda raw: [np.frombuffer(x, np.uint64) for x in raw])
    return components(_connected_in_cells(rows, sizes, sets, "shingles", links))


def near_documents(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Documents are linked when 100 * |intersection| >= percent * |union| of their sets of five-word
    shingles (all words where they are fewer); a pair at exactly that similarity is missed in at
    most MISSED of cases (see `agreeing`), a closer one more rarely. Texts that are null, empty or without words have an
    empty set and are linked with nothing. component_id is the smallest doc_id that links reach,
    the document's own included; kept marks it. Rows with equal sets are linked, repeated rows
    included. A row without an id is in the component of its set but does not name it, and a set
    that only such rows have links nothing. An empty table gives no rows; other columns are ignored.
    """
    spark, before = docs.sparkSession, tables()
    classed = written(classes_of(docs))
    classes = _classes(classed)
    members = written(_candidate_groups(classes, agreeing(percent)).join(classes.select("node", "rep", "text_key", "n_shingles"), "node"))
    forget_but(spark, before, classed, classes, members)
    found = _linked(docs, members, percent)
    forget_but(spark, before, classed, classes, found)
    named = found.join(classes.select("node", "rep"), "node")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = classes.select("node", "class", "rep").join(found, "node", "left").join(least, "component", "left").select("class", F.coalesce("component_id", "rep").alias("component_id"))
    out = classed.select("doc_id", "text_key", "class", "n_shingles").join(by_class, "class", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "text_key")


def without_near_copies(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One document of each component, the one of the smallest id, with the columns that it had.

    Rows without an id stay where no row with an id has their set; of rows with the same id and
    text one stays.
    """
    found = near_documents(docs, percent).where("kept or component_id is null").select("doc_id", "text_key").distinct()
    id_, text = F.col("row.doc_id").cast("long"), F.xxhash64(F.col("row.text").cast("string"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", id_.alias("id"), text.alias("key"))
    kept = rows.join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left_semi")
    return kept.dropDuplicates(["id", "key"]).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
