"""Running layouts, heading context, packing into windows, repeats and copies."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from evidentia.functions.text import boilerplate, heading_boilerplate
from evidentia.operators.components import components
from evidentia.session import ship

#: Rows of two longs that a side may have to be broadcast, and characters of labels that every task may be told.
BROADCAST_ROWS, TOLD_CHARS = 1_000_000, 2_000_000


def laid_out(blocks: DataFrame, doc: str, position: str, text: str = "text", separator: int = 1) -> DataFrame:
    """Blocks with start and end in the text that their document's blocks make, joined by a separator of that many characters."""
    before = Window.partitionBy(doc).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    n = F.length(F.coalesce(text, F.lit("")))
    start = F.coalesce(F.sum(n + separator).over(before), F.lit(0))
    return blocks.withColumn("start", start).withColumn("end", F.col("start") + n)


def last_of(rows: DataFrame, doc: str, position: str, condition: Column, value: Column, name: str) -> DataFrame:
    """Rows with the value at the last row before or at them that meets the condition."""
    over = Window.partitionBy(doc).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(F.when(condition, value), ignorenulls=True).over(over))


def extended_until(rows: DataFrame, doc: str, position: str, opens: Column, closes: Column, value: Column, name: str) -> DataFrame:
    """A value from each opening row on, up to the next row that closes; a row that closes may open anew."""
    over = Window.partitionBy(doc).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    state = F.when(opens, F.struct(value.alias("v"))).when(closes, F.struct(F.lit(None).cast("string").alias("v")))
    return rows.withColumn(name, F.last(state, ignorenulls=True).over(over)["v"])


def boilerplate_masks(elements: DataFrame, doc: str = "doc_id", position: str = "position") -> DataFrame:
    """Headings, paragraphs, list items and footnotes that are boilerplate, with their category.

    A heading of a boilerplate section masks itself and the blocks behind it up to the next heading
    or table; page artifacts and other elements neither stop it nor are masked. Any other block is
    masked by its own phrases. Needs type and text.
    """
    kind = F.col("type")
    opens = (kind == "heading") & heading_boilerplate(F.col("text")).isNotNull()
    held = extended_until(elements, doc, position, opens, kind.isin("heading", "table"), heading_boilerplate(F.col("text")), "__held")
    out = held.withColumn("category", F.coalesce("__held", boilerplate(F.col("text")))).drop("__held")
    return out.where(kind.isin("heading", "paragraph", "list_item", "footnote") & F.col("category").isNotNull())


def packed_windows(blocks: DataFrame, doc: str, position: str, size: str, budget: int | None) -> DataFrame:
    """(doc, position, window): whole blocks in order, a new window whenever the next would pass the budget; a block over it stands alone.

    Each document is read in order with one running sum, so nothing but a batch is held.
    """
    ship(blocks.sparkSession)
    rows = blocks.select(doc, position, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__size"))
    if budget is None:
        return rows.select(doc, position, F.lit(0).cast("long").alias("window"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, window, used = object(), 0, 0
        for frame in frames:
            out = []
            for d, n in zip(frame[doc].tolist(), frame["__size"].tolist(), strict=True):
                if d != last:
                    last, window, used = d, 0, n
                elif used + n <= budget:
                    used += n
                else:
                    window, used = window + 1, n
                out.append(window)
            yield pd.DataFrame({doc: frame[doc], position: frame[position], "window": out})

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, doc).sortWithinPartitions(doc, position).mapInPandas(run, f"`{doc}` {kind[doc]}, `{position}` {kind[position]}, window long")


def repeats(blocks: DataFrame, doc: str, text: str, least: int = 3, words: int = 12) -> DataFrame:
    """Short blocks that a document repeats at least that often, with their counts."""
    short = blocks.where((F.size(F.split(F.trim(F.col(text)), r"\s+")) <= words) & (F.trim(F.col(text)) != ""))
    return short.groupBy(doc, F.trim(F.col(text)).alias(text)).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def exact_groups(docs: DataFrame, keys: list[Column], doc: str = "doc_id") -> DataFrame:
    """Each document with the smallest id of those that agree in the keys and the size of their group.

    The text is hashed before the shuffle, and the smallest ids are combined map-side.
    """
    hashed = docs.select(doc, F.sha2(F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]), {"ignoreNullFields": "false"}), 256).alias("__h"))
    groups = hashed.groupBy("__h").agg(F.min(doc).alias("representative"), F.count("*").alias("n_copies"))
    return hashed.join(groups, "__h").select(doc, "representative", "n_copies")


def connected(edges: DataFrame, nodes: DataFrame, a: str = "a", b: str = "b", node: str = "doc_id") -> DataFrame:
    """Each node with the smallest node that it reaches; edges that name another node are left out."""
    own = nodes.select(node).distinct()
    known = edges.join(own.select(F.col(node).alias(a)), a, "left_semi").join(own.select(F.col(node).alias(b)), b, "left_semi")
    found = components(known, a, b).select(F.col("node").alias(node), "component")
    return own.join(found, node, "left").select(node, F.coalesce("component", node).alias("component"))


def copy_groups(docs: DataFrame, asserted: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Disclosure groups from equal (event, entity, period, type, hash) and asserted copies (a, b).

    Representatives are smallest ids; a group whose documents were processed differently is a
    copy_processing_conflict. Asserted pairs must agree in all but the hash.
    """
    same = ["event_id", "entity_id", "period_end", "doc_type"]
    groups = exact_groups(docs, [F.col(c) for c in [*same, "canonical_hash"]])
    d = docs.select("doc_id", F.struct(*same).alias("subject"))
    pairs = asserted.join(d.select(F.col("doc_id").alias("a"), F.col("subject").alias("sa")), "a").join(d.select(F.col("doc_id").alias("b"), F.col("subject").alias("sb")), "b")
    checked = pairs.withColumn("b", F.when(~F.col("sa").eqNullSafe(F.col("sb")), F.raise_error(F.lit("asserted copies differ in subject")).cast("string")).otherwise(F.col("b")))
    edges = groups.select(F.col("doc_id").alias("a"), F.col("representative").alias("b")).unionByName(checked.select("a", "b"))
    found = connected(edges, docs)
    kinds = found.join(fingerprints, "doc_id", "left").groupBy("component").agg(F.count_distinct("fingerprint").alias("n"))
    status = F.when(F.col("n") > 1, "copy_processing_conflict").otherwise("consistent")
    return found.join(kinds, "component").select("doc_id", F.col("component").alias("representative_doc_id"), status.alias("status"))


class _Windows:
    """All windows of the labels, with a table of their rolling hashes that leaves most places of a text unlooked at."""

    BASE, PIECE, BITS = 0x9E3779B97F4A7C15, 1 << 16, 22

    def __init__(self, labels: list[tuple], width: int):
        self.width, self.ids = width, {}
        for name, text in labels:
            for at in range(len(text) - width + 1):
                self.ids.setdefault(text[at : at + width], set()).add(name)
        back = pow(self.BASE, -1, 1 << 64)
        ones = [np.full(self.PIECE + width, x, np.uint64) for x in (self.BASE, back)]
        for x in ones:
            x[0] = 1
        self.powers, self.inverse = map(np.cumprod, ones)
        self.table = np.zeros(1 << self.BITS, bool)
        for name, text in labels:
            for _, places in self.places(text):
                self.table[places] = True

    def places(self, text: str) -> Iterator[tuple[int, np.ndarray]]:
        """(offset, places in the table of the windows from there on) of a text, some thousands of windows at a time."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, len(codes) - self.width + 1, self.PIECE):
            part = codes[at : at + self.PIECE + self.width - 1].astype(np.uint64) + np.uint64(1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * self.powers[: len(part)])])
            n = len(part) - self.width + 1
            yield at, (((sums[self.width :] - sums[:n]) * self.inverse[:n]) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.BITS)

    def hits(self, text: str) -> set:
        """The labels that share a window with the text."""
        found: set = set()
        for offset, places in self.places(text):
            for at in np.flatnonzero(self.table[places]).tolist():
                found |= self.ids.get(text[offset + at : offset + at + self.width], frozenset())
        return found


_windows_held: dict[str, _Windows] = {}


def _hits_in_one_pass(labels: list[tuple], labels_type: DataType, texts: DataFrame, width: int, schema: str) -> DataFrame:
    """(label_id, text_id) pairs by one pass over the texts, the labels held by every worker."""
    spark, name = texts.sparkSession, uuid.uuid4().hex
    ship(spark)
    told = spark.sparkContext.broadcast(labels)
    kind = to_arrow_type(labels_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _windows_held:
            _windows_held.clear()
            _windows_held[name] = _Windows(told.value, width)
        held = _windows_held[name]
        for batch in batches:
            pairs = [(label, text_id) for text_id, text in zip(batch.column("text_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if text for label in held.hits(text)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], kind), pa.array([p[1] for p in pairs], batch.column("text_id").type)], names=["label_id", "text_id"])

    found = texts.select("text_id", "text").mapInArrow(run, schema)
    return found.distinct()  # a text may come in several rows


def shingle_hits(labels: DataFrame, texts: DataFrame, width: int = 40) -> DataFrame:
    """(label_id, text_id) pairs that share a run of `width` characters, full dates masked.

    Labels of up to TOLD_CHARS characters in all are told to every worker, and one pass over the
    texts looks up the windows that a rolling hash does not rule out. With more labels, windows
    meet by their 64-bit hashes, made distinct within a text before the shuffle, and the pairs that
    meet are confirmed on the windows themselves. Rows without a text share nothing.
    """
    from evidentia.functions.text import char_windows, dates_masked

    size = labels.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    if size <= TOLD_CHARS:
        mask = dates_masked(F.col("text")).alias("text")
        told = [tuple(r) for r in labels.where("text is not null").select("label_id", mask).collect()]
        kinds = f"label_id {labels.schema['label_id'].dataType.simpleString()}, text_id {texts.schema['text_id'].dataType.simpleString()}"
        return _hits_in_one_pass(told, labels.schema["label_id"].dataType, texts.select("text_id", mask), width, kinds)

    def windows(rows: DataFrame, name: str) -> DataFrame:
        found = F.array_distinct(F.transform(char_windows(dates_masked(F.col("text")), width), lambda w: F.xxhash64(w)))
        return rows.select(name, F.explode(found).alias("h"))

    a, b = windows(labels, "label_id"), windows(texts, "text_id")
    if a.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # two longs a row; beyond it both sides are shuffled
        a = F.broadcast(a)
    pairs = a.join(b, "h").select("label_id", "text_id").distinct()
    named = pairs.join(labels.select("label_id", F.col("text").alias("__l")), "label_id").join(texts.select("text_id", F.col("text").alias("__t")), "text_id")
    shared = F.arrays_overlap(char_windows(dates_masked(F.col("__l")), width), char_windows(dates_masked(F.col("__t")), width))
    return named.where(shared).select("label_id", "text_id").distinct()


def aligned(left: DataFrame, right: DataFrame, doc: str = "doc_id", position: str = "position", text: str = "text") -> DataFrame:
    """Anchored alignment of two unit sequences of a document: texts unique on both sides that lie on every longest increasing chain, then equal neighbours.

    One document's units are gathered in a task, which a document bounds.
    """
    ship(left.sparkSession)

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values(position), b.sort_values(position)
        xs, ys = a[text].tolist(), b[text].tolist()
        once_a = {t: i for i, t in enumerate(xs) if xs.count(t) == 1} if len(xs) < 2000 else _once(xs)
        once_b = {t: i for i, t in enumerate(ys) if ys.count(t) == 1} if len(ys) < 2000 else _once(ys)
        pairs = sorted((once_a[t], once_b[t]) for t in once_a.keys() & once_b.keys())
        matched = dict(on_every_chain(pairs))
        changed = True
        while changed:
            changed = False
            taken = set(matched.values())
            for i, j in list(matched.items()):
                for d in (-1, 1):
                    if 0 <= i + d < len(xs) and 0 <= j + d < len(ys) and i + d not in matched and j + d not in taken and xs[i + d] == ys[j + d]:
                        matched[i + d] = j + d
                        taken.add(j + d)
                        changed = True
        rows = sorted(matched.items())
        return pd.DataFrame({doc: [key[0]] * len(rows), "left_position": [a[position].iloc[i] for i, _ in rows], "right_position": [b[position].iloc[j] for _, j in rows]})

    kind = {f.name: f.dataType.simpleString() for f in left.schema}
    return left.groupBy(doc).cogroup(right.groupBy(doc)).applyInPandas(run, f"`{doc}` {kind[doc]}, left_position long, right_position long")


def _once(values: list[str]) -> dict[str, int]:
    seen: dict[str, int | None] = {}
    for i, v in enumerate(values):
        seen[v] = None if v in seen else i
    return {v: i for v, i in seen.items() if i is not None}


def on_every_chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs sorted by their first place: those that every longest chain increasing in the second has."""
    from bisect import bisect_left

    def lengths(values: list[int]) -> list[int]:
        tails: list[int] = []
        out = []
        for v in values:
            k = bisect_left(tails, v)
            tails[k : k + 1] = [v]
            out.append(k + 1)
        return out

    seconds = [j for _, j in pairs]
    ahead, behind = lengths(seconds), lengths([-v for v in reversed(seconds)])[::-1]
    longest = max(ahead, default=0)
    held: dict[int, list[int]] = {}
    for n, (x, y) in enumerate(zip(ahead, behind, strict=True)):
        if x + y - 1 == longest:
            held.setdefault(x, []).append(n)
    return [pairs[v[0]] for v in held.values() if len(v) == 1]
