"""Exact removal of repeated byte strings with a logarithmic family of suffix arrays.

A byte goes if a string of SPAN bytes covers it that also starts earlier: in a document of a
smaller id, or earlier in its own. Suffixes are compared to the depth of SPAN, so a suffix is
the window of SPAN bytes that starts with it, and comparisons are of bytes throughout.

A SuffixFamily holds a store of bytes and levels of suffix arrays, positions in the store in the
order of their windows. A new batch of texts gets an array of its own, in which equal neighbours
are repeats; it is merge-scanned against each level for windows that were there before; what is
left joins the family as a level, and levels of one size class merge.

The work is divided by content. Each window has an anchor: the leftmost of its grams of GRAM
bytes with the least hash, which depends on the window's bytes alone. Equal windows have equal
anchors, so all suffixes with one anchor hash meet in one place and nowhere else. The windows of
one anchor are neighbours and form a segment. A segment whose anchor hash occurs nowhere else
can hold no repeat, so it never leaves its text. The others' bytes are fetched and go to the
family of their anchor hashes, where all batches meet in the order of documents. Stores take
equal texts once: of segments with equal bytes only the first leaves a batch of texts, and an
anchor hash all of whose segments have equal bytes needs no suffix array.

Anchor hashes that very many documents have, such as that of a short line in a third of them,
are looked for in a sample; their segments go on as single windows, dealt by a hash of their
bytes, so that no task gets all of them. The sample decides where a window is compared, never
whether or how.

A RepeatFamily keeps its texts and its anchored positions as tables in the shared folder, so
that batches of documents can be added one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.llm.common import PIECE, bucketed, byte_rows, emit, prefix_hash, ship, span_hash, written

SPAN, GRAM = 100, 24
#: Windows that can share an anchor.
_SHARE = SPAN - GRAM + 1
_LOW = np.uint64((1 << 23) - 1)
#: Windows in a batch of a family, and windows from which on a family is closed at the next anchor hash.
BATCH, FAMILY = 1 << 15, 1 << 17
#: Documents that frequent anchor hashes are looked for in at most, times that one must occur among them, and hashes that are kept at most.
SAMPLE, LEAST, HELD = 20_000, 32, 100_000
#: Bits of a row number that tell the batch of documents.
TURN = 53

_ROWS = pa.schema([("key", pa.int64()), ("rid", pa.int64()), ("at", pa.int64())])
_ROWS_SQL = "key long, rid long, at long"


def _least_before(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` neighbours."""
    out, span = x, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, key) of the segments of texts that lie side by side and end at `ends`; at most PIECE bytes."""
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none, none, none.astype(np.uint64)
    prefix = prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = span_hash(prefix, at, at + GRAM)
    anchor = (_least_before((grams & ~_LOW) | at.astype(np.uint64), _SHARE) & _LOW).astype(np.int64)
    inside = np.ones(len(anchor), bool)
    for end in ends[:-1].tolist():  # windows that run over the end of a text
        inside[max(0, end - SPAN + 1) : end] = False
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(anchor)))
    starts, counts = starts[inside[starts]], counts[inside[starts]]
    return starts, counts, grams[anchor[starts]]


def _pieces(rows: list, most: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Lists of (row, offset, bytes) of at most `most` bytes; longer texts are cut so that each window is whole in one piece."""
    held, size = [], 0
    for n, row in enumerate(rows):
        data = np.frombuffer(row, np.uint8)
        if len(data) < SPAN:
            continue
        if size + len(data) > most and held:
            yield held
            held, size = [], 0
        if len(data) <= most:
            held.append((n, 0, data))
            size += len(data)
        else:
            for a in range(0, len(data) - SPAN + 1, most - SPAN + 1):
                yield [(n, a, data[a : a + most])]
    if held:
        yield held


def ordinals(doc_id: pa.Array) -> np.ndarray:
    """The order of documents: by id, those without one last."""
    return pc.fill_null(doc_id, 2**63 - 1).to_numpy(zero_copy_only=False)


def _segmented(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, windows, key) of the segments of the texts of an Arrow column."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]]
    for piece in _pieces(byte_rows(texts), PIECE):
        lengths = np.array([len(d) for _, _, d in piece])
        ends = np.cumsum(lengths)
        start, count, key = segments(np.concatenate([d for _, _, d in piece]), ends)
        owner = np.searchsorted(ends, start, side="right")
        offset = np.array([a for _, a, _ in piece])[owner] - (ends - lengths)[owner]
        for column, values in zip(parts, (np.array([n for n, _, _ in piece])[owner], start + offset, count, key), strict=True):
            column.append(values)
    return tuple(map(np.concatenate, parts))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments as rows; `at` is start * 256 + windows * 2 + whether the batch has the key several times.

    The first segment of a key in a batch speaks for it. The others are asked for in any case, so
    their `at` is inverted and they need not meet.
    """
    for batch in batches:
        row, start, count, key = _segmented(batch.column("text"))
        sort = np.argsort(key, kind="stable")
        key, row, at = key[sort], row[sort], (start * 256 + count * 2)[sort]
        again = np.append(False, key[1:] == key[:-1])[: len(key)]
        several = np.append(again[1:], False)[: len(key)] & ~again
        yield from emit(_ROWS, [key.view(np.int64), batch.column("rid").to_numpy()[row], np.where(again, ~at, at | several)])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, n = np.unique(_segmented(batch.column("text"))[3], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])


def frequent_anchors(texts: DataFrame) -> np.ndarray:
    """Anchor hashes that occur LEAST times or more in about SAMPLE of the texts, the HELD most frequent at most, sorted."""
    share = SAMPLE / max(1, texts.count())
    sampled = texts if share >= 1 else texts.where(F.pmod(F.xxhash64("rid", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000))
    counts = sampled.select("text").mapInArrow(_anchors, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "key").limit(HELD).select("key").collect()
    return np.sort(np.array([r["key"] for r in rows], np.int64))


def merged(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each group with touching and overlapping ones made one."""
    if not len(start):
        return group, start, end
    sort = np.lexsort((start, group))
    group, start, end = group[sort], start[sort], end[sort]
    # Lifting each group above the one before lets one running maximum serve all.
    numbers, code = np.unique(group, return_inverse=True)
    lift = code * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] + lift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return group[first], start[first], reach[last] - lift[last]


def _asked(oldest: int):
    """Of rows that are sorted by key and falling rid: those of keys that occur again and that a row from `oldest` on has.

    What is carried from batch to batch is one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waiting, open_asked = None, None, False
        for batch in batches:
            key, rid, at = (batch.column(c).to_numpy() for c in _ROWS.names)
            known = at < 0
            if known.any():
                yield from emit(_ROWS, [key[known], rid[known], ~at[known]])
                key, rid, at = key[~known], rid[~known], at[~known]
            if not len(key):
                continue
            new = np.append(True, key[1:] != key[:-1])
            new[0] = key[0] != last
            group = np.cumsum(new)  # 0: goes on with the key of the batch before
            n = int(group[-1]) + 1
            first = np.flatnonzero(new)
            asked = np.zeros(n, bool)
            asked[1:] = (rid[first] >= oldest) & ((np.bincount(group, minlength=n)[1:] > 1) | (at[first] & 1 > 0))
            if not new[0]:
                if waiting:
                    yield from emit(_ROWS, [[x] for x in waiting])
                asked[0] = open_asked or waiting is not None
            taken = asked[group]
            if taken.any():
                yield from emit(_ROWS, [key[taken], rid[taken], at[taken]])
            open_asked, waiting, last = bool(asked[-1]), None, key[-1]
            if n > 1 and not open_asked and rid[first[-1]] >= oldest:
                waiting = int(key[-1]), int(rid[-1]), int(at[-1])

    return run


class SuffixFamily:
    """A store of bytes and levels of suffix arrays over it, their sizes in different classes of powers of two."""

    def __init__(self, span: int = SPAN):
        self.span, self.store, self.used = span, np.zeros(1 << 16, np.uint8), 0
        self.levels: list[np.ndarray] = []

    def __len__(self) -> int:
        return sum(map(len, self.levels))

    def windows(self, places: np.ndarray) -> np.ndarray:
        """The windows at places of the store, ordered like their bytes."""
        view = np.lib.stride_tricks.sliding_window_view(self.store, self.span)
        return view[places].view(f"S{self.span}").ravel()

    def _stored(self, texts: list[bytes]) -> np.ndarray:
        """Where each text begins in the store, after they have been put there."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        while self.used + len(data) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[self.used : self.used + len(data)] = data
        begins = self.used + np.cumsum([0, *map(len, texts)])[:-1]
        self.used += len(data)
        return begins

    @staticmethod
    def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The order that merges two sorted arrays, of equal windows those of the first ahead."""
        return np.argsort(np.concatenate([a, b]), kind="stable")  # two runs: one merge

    def add(self, texts: list[bytes]) -> np.ndarray:
        """Whether each window of each text of a batch, in the order of documents, was there before it; the batch joins the family.

        The store takes equal texts of a batch once: of these all windows but the first's are repeats.
        """
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(t, len(number)) for t in texts], np.int64)
        lengths = np.array([len(t) - self.span + 1 for t in number], np.int64)
        ends = np.cumsum(lengths)
        places = np.arange(int(ends[-1])) + np.repeat(self._stored(list(number)) - (ends - lengths), lengths)
        windows = self.windows(places)
        order = np.argsort(windows, kind="stable")
        array = windows[order]
        again = np.append(False, array[1:] == array[:-1])
        order, array, found = order[~again], array[~again], np.ones(len(places), bool)
        for level in self.levels:
            held = self.windows(level)
            merge = self._merged(held, array)
            both = np.concatenate([held, array])[merge]
            met = merge[1:][both[1:] == both[:-1]] - len(held)  # a level's windows differ, so these are the batch's
            order, array = np.delete(order, met), np.delete(array, met)
        found[order] = False
        fresh = places[order]
        while len(fresh) and self.levels and len(self.levels[-1]).bit_length() <= len(fresh).bit_length():
            level = self.levels.pop()
            held, array = self.windows(level), self.windows(fresh)
            fresh = np.concatenate([level, fresh])[self._merged(held, array)]
        if len(fresh):
            self.levels.append(fresh)
        out = np.ones(int((lengths[which]).sum()), bool)
        firsts = np.append(True, np.maximum.accumulate(which)[1:] > np.maximum.accumulate(which)[:-1])
        out[np.repeat(firsts, lengths[which])] = found
        return out


def _compared_batch(family: SuffixFamily, texts: list[bytes]) -> np.ndarray:
    """The family's answer for texts of any number of windows, BATCH of them at a time."""
    sizes = np.cumsum([len(t) - SPAN + 1 for t in texts])
    edges = np.unique([0, *(np.searchsorted(sizes, np.arange(BATCH, int(sizes[-1]) + BATCH, BATCH), side="right")).tolist(), len(texts)])
    return np.concatenate([family.add(texts[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)])


_SPANS = pa.schema([("rid", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_FETCHED = pa.schema([("key", pa.int64()), ("part", pa.int64()), ("ord", pa.int64()), ("rid", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("data", pa.binary())])
_FETCHED_SQL = "key long, part long, ord long, rid long, start long, end long, data binary"


def _fetched(frequent: np.ndarray):
    """The bytes of the asked segments of texts, of equal ones in a batch those of the first; and the spans of the others.

    Segments of frequent anchor hashes go on as single windows. A row with an `end` is a span.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders, rids, texts = ordinals(batch.column("doc_id")), batch.column("rid").to_numpy(), byte_rows(batch.column("text"))
            asks = batch.column("asked")
            first = asks.offsets.to_numpy() - asks.offsets[0].as_py()
            keys, ats = (asks.flatten().field(n).to_numpy() for n in ("key", "at"))
            row = np.repeat(np.arange(len(rids)), np.diff(first))
            begin, count = ats >> 8, (ats & 255) >> 1
            often = np.isin(keys, frequent)
            if often.any():  # a segment as its windows
                n = np.where(often, count, 1)
                item = np.repeat(np.arange(len(row)), n)
                begin = begin[item] + np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
                keys, row, count, often = keys[item], row[item], np.where(often, 1, count)[item], often[item]
            sort = np.lexsort((begin, rids[row], orders[row], rids[row] >> TURN))
            keys, row, begin, count, often = keys[sort], row[sort], begin[sort], count[sort], often[sort]
            data = [bytes(texts[r][s : s + c - 1 + SPAN]) for r, s, c in zip(row.tolist(), begin.tolist(), count.tolist(), strict=True)]
            new = _firsts(data)
            if not new.all():
                r, s, e = merged(row[~new], begin[~new], (begin + count - 1 + SPAN)[~new])
                yield from emit(_FETCHED, [rids[r], np.zeros(len(r), np.int64), orders[r], rids[r], s, e, pa.nulls(len(r), pa.binary())])
            taken = np.flatnonzero(new)
            part = np.zeros(len(taken), np.int64)
            for i in np.flatnonzero(often[taken]).tolist():
                part[i] = int.from_bytes(hashlib.blake2b(data[taken[i]], digest_size=8).digest(), "little", signed=True)
            row = row[taken]
            yield from emit(_FETCHED, [keys[taken], part, orders[row], rids[row], begin[taken], pa.nulls(len(taken), pa.int64()), [data[i] for i in taken.tolist()]], 5_000)

    return run


def _firsts(data: list[bytes]) -> np.ndarray:
    """Which of the byte strings did not come before."""
    seen: set[bytes] = set()
    return np.array([not (d in seen or seen.add(d)) for d in data], bool)


def _alone(key: np.ndarray, part: np.ndarray, data: list[bytes]) -> np.ndarray:
    """Which rows belong to an anchor hash (and part) that lies whole in the batch and whose bytes are all equal."""
    new = np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]))
    run = np.cumsum(new) - 1
    differs = np.zeros(int(run[-1]) + 1, bool)
    differs[[0, -1]] = True  # these may go on in another batch
    for i in np.flatnonzero(~new).tolist():
        if data[i] != data[i - 1]:
            differs[run[i]] = True
    return ~differs[run]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the windows that the family of their anchor hash held before.

    The rows come sorted by anchor hash, part, batch and document. One family goes on from anchor
    hash to anchor hash until it is large; equal windows have equal anchor hashes and parts.
    """
    family, last = SuffixFamily(), None
    for batch in batches:
        spans = batch.column("end").is_valid()
        if pc.any(spans).as_py():
            own = batch.filter(spans)
            yield pa.RecordBatch.from_arrays([own.column(c) for c in _SPANS.names], schema=_SPANS)
            batch = batch.filter(pc.invert(spans))
        if not batch.num_rows:
            continue
        key, part, rid, start = (batch.column(c).to_numpy() for c in ("key", "part", "rid", "start"))
        data = batch.column("data").to_pylist()
        alone = _alone(key, part, data)
        again = alone.copy()
        again[1:] &= (key[1:] == key[:-1]) & (part[1:] == part[:-1])
        again[0] = False
        if again.any():
            at = np.flatnonzero(again)
            yield from emit(_SPANS, merged(rid[at], start[at], start[at] + [len(data[i]) for i in at.tolist()]))
        kept = np.flatnonzero(~alone)
        key, part, rid, start, data = key[kept], part[kept], rid[kept], start[kept], [data[i] for i in kept.tolist()]
        new = np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]))
        new[0] = (key[0], part[0]) != last
        last = key[-1], part[-1]
        ends = np.cumsum([len(d) - SPAN + 1 for d in data])
        at = 0
        while at < len(data):
            if len(family) > FAMILY:  # it is closed at the next anchor hash
                upto = at + int(np.argmax(new[at:])) if new[at:].any() else len(data)
                if upto == at:
                    family = SuffixFamily()
                    continue
            else:
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + FAMILY, side="right")))
            found = _compared_batch(family, data[at:upto])
            if found.any():
                counts = np.diff(np.append(ends[at - 1] if at else 0, ends[at:upto]))
                owner = np.repeat(np.arange(at, upto), counts)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + start[owner]
                yield from emit(_SPANS, merged(rid[owner[found]], place[found], place[found] + SPAN))
            at = upto


def _kept(schema: pa.Schema, as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each text: the bytes that stay and the maximal runs that go."""
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            spans = batch.column("spans").to_pylist()
            for n, text in enumerate(byte_rows(batch.column("text"))):
                runs: list[tuple[int, int]] = []
                for a, b in sorted((s["start"], s["end"]) for s in spans[n] or []):
                    if runs and a <= runs[-1][1]:
                        runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
                    else:
                        runs.append((a, b))
                kept = b"".join(text[a:b] for a, b in zip([0, *[b for _, b in runs]], [*[a for a, _ in runs], len(text)], strict=True)) if runs else bytes(text)
                for column, value in zip(out, (len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": b} for a, b in runs]), strict=True):
                    column.append(value)
            columns = [batch.column("doc_id"), batch.column("rest"), *out]
            whole = schema.set(1, pa.field("rest", batch.column("rest").type))
            if as_text:  # a character of which some bytes went is dropped whole
                columns = [*columns[:2], [k.decode("utf-8", "ignore") for k in out[4]]]
                whole = pa.schema([whole[0], whole[1], pa.field("text", pa.string())])
            yield from emit(whole, columns, 500)

    return run


_KEPT = pa.schema(
    [("doc_id", pa.int64()), ("rest", pa.null()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
    + [("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


class RepeatFamily:
    """Documents in batches, one after the other; a byte goes if it repeats one of its own batch or of an earlier one.

    The texts are the store; the levels are tables of anchored positions (anchor hash, text,
    place), sorted by anchor hash. A new batch is merge-scanned against all levels for anchor hashes
    that occur again, and the bytes of these alone are fetched. Its own positions join as a level;
    levels of one size class merge into one table.
    """

    #: Batches that row numbers can tell apart.
    MOST = 1 << (63 - TURN)

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark, self.turn = spark, 0
        self.texts: list[DataFrame] = []
        self.levels: list[tuple[DataFrame, int]] = []

    def add(self, docs: DataFrame, carry: list[str] | None = None, as_text: bool = False, last: bool = False) -> DataFrame:
        """The rows of deduplicated() for a further batch. With `last` nothing is kept of it, since no other batch follows."""
        if self.turn >= self.MOST:
            raise ValueError(f"a family takes {self.MOST} batches; merge them into fewer, larger ones")
        rest = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(None).cast("int").alias("none"))
        oldest = self.turn << TURN
        number = F.monotonically_increasing_id()
        rid = F.when(number < (1 << TURN), number + F.lit(oldest)).otherwise(F.raise_error(F.lit("more input splits than row numbers can tell apart")).cast("long"))
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"), rid.alias("rid"))
        texts = bucketed(texts, "rid")  # every use sees the same numbers
        rows = texts.select("rid", "text").mapInArrow(_cut, _ROWS_SQL)
        if not last:
            rows = written(rows)
        meeting = rows
        for level, _ in self.levels:
            meeting = meeting.unionByName(level)
        spans = self._spans([texts, *self.texts], meeting, frequent_anchors(texts), oldest)
        found = spans.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        joined = texts.join(found.hint("merge"), "rid", "left").select("doc_id", "rest", "text", "spans")
        kind = texts.schema["rest"].dataType.simpleString()
        if not last:
            self._keep(texts.select("doc_id", "rid", "text"), rows)
        if as_text:
            return joined.mapInArrow(_kept(_KEPT, True), f"doc_id long, rest {kind}, text string")
        return joined.mapInArrow(_kept(_KEPT, False), f"doc_id long, rest {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<struct<start:long,end:long>>")

    def _spans(self, texts: list[DataFrame], rows: DataFrame, frequent: np.ndarray, oldest: int) -> DataFrame:
        """(rid, start, end) of the repeats in texts from the row number `oldest` on."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartition(parts, F.when(F.col("at") < 0, F.col("rid")).otherwise(F.col("key"))).sortWithinPartitions("key", F.desc("rid"))
        asked = bucketed(dealt.mapInArrow(_asked(oldest), _ROWS_SQL), "rid").groupBy("rid").agg(F.collect_list(F.struct("key", "at")).alias("asked"))
        fetched = None
        for store in texts:
            some = store.select("doc_id", "rid", "text").join(asked.hint("merge"), "rid").mapInArrow(_fetched(frequent), _FETCHED_SQL)
            fetched = some if fetched is None else fetched.unionByName(some)
        order = ["key", "part", F.shiftright("rid", TURN), "ord", "rid", "start"]
        compared = fetched.repartition(parts, "key", "part").sortWithinPartitions(*order).mapInArrow(_compared, "rid long, start long, end long")
        return compared.where(F.col("rid") >= oldest)

    def _keep(self, texts: DataFrame, rows: DataFrame) -> None:
        """The batch's texts and its positions join the family."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        merging, size = [rows.withColumn("at", F.when(F.col("at") < 0, F.bitwise_not("at")).otherwise(F.col("at")))], rows.count()
        while self.levels and self.levels[-1][1].bit_length() <= size.bit_length():
            level, n = self.levels.pop()
            merging.append(level)
            size += n
        whole = merging[0]
        for level in merging[1:]:
            whole = whole.unionByName(level)
        self.levels.append((written(whole.repartition(parts, "key").sortWithinPartitions("key", F.desc("rid"))), size))
        self.texts.append(texts)
        self.turn += 1


def deduplicated(docs: DataFrame, carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """doc_id, rest, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay) and removed (the spans) of every row.

    Texts are UTF-8 bytes, null ones empty; matches never cross documents. Rows that repeat an id
    are documents of their own in the order of the input, and rows without an id come after all
    others. Texts under SPAN bytes are kept whole. `rest` is a struct of the columns named in
    `carry`, others are ignored. An empty table gives no rows. With `as_text` the rows have doc_id,
    rest and the text that stays.
    """
    return RepeatFamily(docs.sparkSession).add(docs, carry, as_text, last=True)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; see deduplicated()."""
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with the columns that they had, their texts without the repeated bytes.

    A character of which only some bytes go is dropped whole; n_chars, where there is one,
    counts what is left. Documents of which nothing is left stay, with an empty text.
    """
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    texts = deduplicated(docs, names, as_text=True)
    columns = {c: F.col(f"rest.`{c}`") for c in names} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return texts.select(*[columns[c].alias(c) for c in docs.columns])
