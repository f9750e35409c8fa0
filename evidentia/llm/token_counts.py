"""Token counts without ids: pieces are counted once per distinct pre-token.

Documents of a part of the input become one block. A block sends one row per distinct pre-token
with its postings (document, frequency). All rows of a pre-token meet in one sorted run, where
its pieces are counted once and joined to the postings; the products are summed by document
and go back to their blocks. A frequent pre-token's long postings are dealt over all partitions,
and each that gets some counts its pieces once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidentia.llm.common import byte_rows, ship, texts_of
from evidentia.llm.tokens import byte_bpe, token_file

#: Bytes of text after which a block ends, documents that it holds at most, and pre-tokens after which it ends.
BLOCK_BYTES, BLOCK_DOCS, BLOCK_WORDS = 32 << 20, 60_000, 8_000_000

#: Postings that are summed at once, and bytes of a block's postings from which on a pre-token is dealt by block as well.
FLUSH, HOT = 4_000_000, 256

_ROWS = pa.schema([("block", pa.int64()), ("pretoken", pa.string()), ("postings", pa.binary())])
_PAIR = np.dtype([("doc", "<u2"), ("freq", "<u2")])
_SUM = np.dtype([("doc", "<u2"), ("tokens", "<u8")])
_PARTIAL = pa.schema([("block", pa.int64()), ("head", pa.bool_()), ("sums", pa.binary())])
_DOC = np.dtype([("doc_id", "<i8"), ("null", "<i8"), ("n_bytes", "<i8")])


class _Block:
    def __init__(self, number: int):
        self.number, self.size, self.words = number, 0, 0
        self.local: defaultdict[str, int] = defaultdict(lambda: len(self.local))
        self.ids: list[np.ndarray] = []
        self.freqs: list[np.ndarray] = []
        self.docs: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, n_bytes: int, pretokens: list[str]) -> None:
        self.docs.append((doc_id or 0, doc_id is None, n_bytes))
        ids, freqs = np.unique(np.fromiter(map(self.local.__getitem__, pretokens), np.int32, len(pretokens)), return_counts=True)
        self.ids.append(ids.astype(np.int32))
        self.freqs.append(freqs)
        self.size += n_bytes
        self.words += len(ids)

    @property
    def full(self) -> bool:
        return self.size >= BLOCK_BYTES or len(self.docs) >= BLOCK_DOCS or self.words >= BLOCK_WORDS

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The block's head (no pre-token), then a row for each distinct pre-token."""
        yield pa.RecordBatch.from_arrays([pa.array([self.number]), pa.array([None], pa.string()), pa.array([np.array(self.docs, _DOC).tobytes()], pa.binary())], schema=_ROWS)
        ids = np.concatenate(self.ids)
        docs = np.repeat(np.arange(len(self.docs), dtype=np.uint16), [len(x) for x in self.ids])
        freqs = np.concatenate(self.freqs)
        if (over := freqs > 0xFFFF).any():  # a pair holds 16 bits, so a larger frequency takes several
            times = np.where(over, -(-freqs // 0xFFFF), 1)
            last = np.cumsum(times) - 1
            ids, docs, rest = np.repeat(ids, times), np.repeat(docs, times), freqs - (times - 1) * 0xFFFF
            freqs = np.full(len(ids), 0xFFFF, np.int64)
            freqs[last] = rest
        order = np.argsort(ids, kind="stable")
        pairs = np.empty(len(ids), _PAIR)
        pairs["doc"], pairs["freq"] = docs[order], freqs[order]
        ends = np.cumsum(np.bincount(ids, minlength=len(self.local)))
        words = list(self.local)
        for at in range(0, len(words), 50_000):
            upto = min(len(words), at + 50_000)
            a = int(ends[at - 1]) if at else 0
            offsets = np.concatenate([[0], 4 * (ends[at:upto] - a)]).astype(np.int32)
            postings = pa.Array.from_buffers(pa.binary(), upto - at, [None, pa.py_buffer(offsets), pa.py_buffer(pairs[a : int(ends[upto - 1])].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(upto - at, self.number)), pa.array(words[at:upto], pa.string()), postings], schema=_ROWS)


def _blocks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, bpe = TaskContext.get().partitionId() << 32, byte_bpe(path)
        block = _Block(number)
        for batch in batches:
            for doc_id, text, raw in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), byte_rows(batch.column("text")), strict=True):
                block.add(doc_id, len(raw), bpe.split(text))
                if block.full:
                    yield from block.rows()
                    block = _Block(number := number + 1)
        if block.docs:
            yield from block.rows()

    return run


def _joined(path: str):
    """Piece counts of a partition that is sorted by pre-token, counted once for all rows of a pre-token, joined to the postings.

    The products are summed by document before they leave, a bounded number of postings at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            words, blocks = batch.column("pretoken").to_pylist(), batch.column("block").to_numpy()
            new = [w for w in dict.fromkeys(words) if w is not None and w not in known]
            known.update(zip(new, byte_bpe(path).counts(new).tolist(), strict=True))
            raw = batch.column("postings").to_pylist()
            for i, w in enumerate(words):
                if w is None:  # a block's head goes on as it is
                    yield pa.RecordBatch.from_arrays([pa.array([blocks[i]]), pa.array([True]), pa.array([raw[i]], pa.binary())], schema=_PARTIAL)
                    raw[i] = b""
            sizes = np.array([len(x) >> 2 for x in raw])
            pairs = np.frombuffer(b"".join(raw), _PAIR)
            pieces = np.array([0 if w is None else known[w] for w in words], np.int64)
            held.append((np.repeat(blocks, sizes), pairs["doc"], np.repeat(pieces, sizes) * pairs["freq"]))
            if sum(len(h[0]) for h in held) >= FLUSH:
                yield from _flush(held)
                held = []
            known = {words[-1]: known.get(words[-1], 0)} if words else known
        if held:
            yield from _flush(held)

    return run


def _flush(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """One row for each block, with the sums of its documents."""
    block, doc, tokens = (np.concatenate(c) for c in zip(*held, strict=True))
    if not len(block):
        return
    numbers, code = np.unique(block, return_inverse=True)
    keys, place = np.unique(code * 65536 + doc, return_inverse=True)
    sums = np.empty(len(keys), _SUM)
    sums["doc"], sums["tokens"] = keys & 0xFFFF, np.rint(np.bincount(place, tokens)).astype(np.uint64)
    ends = np.searchsorted(keys >> 16, np.arange(len(numbers)), side="right")
    parts = [sums[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array([False] * len(parts)), pa.array(parts, pa.binary())], schema=_PARTIAL)


def _sums(group: pa.Table) -> pa.Table:
    """Counts of one block from its head and its partial sums."""
    heads, raw = group.column("head").to_pylist(), group.column("sums").to_pylist()
    docs = np.frombuffer(raw[heads.index(True)], _DOC)
    sums = np.frombuffer(b"".join(x for x, h in zip(raw, heads, strict=True) if not h), _SUM)
    tokens = np.zeros(len(docs), np.int64)
    np.add.at(tokens, sums["doc"], sums["tokens"].astype(np.int64))
    return pa.table({"doc_id": pa.array(docs["doc_id"], mask=docs["null"] != 0), "n_bytes": docs["n_bytes"], "n_tokens": tokens})


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    A null text counts as empty: no bytes and no tokens. Repeated rows are counted each. The
    result has no begin, end or padding tokens; special strings inside a text are one token
    each, as the library does by default. A missing doc_id stays missing. Other columns are
    ignored and an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    path = tokenizer or token_file("byte_bpe_50k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_blocks(path), "block long, pretoken string, postings binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    apart = F.when(F.col("pretoken").isNull() | (F.length("postings") > HOT), F.col("block"))
    dealt = rows.repartition(parts, "pretoken", apart).sortWithinPartitions("pretoken")
    counted = dealt.mapInArrow(_joined(path), "block long, head boolean, sums binary")
    out = counted.groupBy("block").applyInArrow(_sums, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


