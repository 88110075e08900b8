"""Filling containers of fixed capacity by best-two-fit.

Only identifiers and sizes leave the JVM, never the texts. Each input split is
packed on its own without a shuffle; it leaves at most a few containers less than
full, among thousands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 8192
CHUNK_DOCS = 1_000_000
PACKED = "container long, doc_id long, piece int, start long, length long"


def byte_size(text: str | Column) -> Column:
    """Tokens of a byte-level tokenizer: bytes of the text in UTF-8; 0 for null."""
    return F.coalesce(F.octet_length(F.col(text) if isinstance(text, str) else text), F.lit(0)).cast("long")


def pack(df: DataFrame, ident: str = "doc_id", size: str | Column | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Put every document into containers: ``container, doc_id, piece, start, length``.

    ``size`` gives a document's size, by default the bytes of ``text``. A document
    above ``capacity`` is divided: full containers of its own, and a rest that is
    packed like a small document; ``piece`` counts from 0. No other document is
    divided. A document of size 0 (null, empty or negative size) takes no space: it
    gets one row with a null container. Repeated rows are packed each time, a null
    identifier is kept. Other columns are not read. An empty table gives no rows.
    """
    n = byte_size("text") if size is None else F.col(size) if isinstance(size, str) else size
    rows = df.select(F.col(ident).cast("long").alias("doc_id"), F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("long").alias("size"))
    return rows.mapInArrow(_pack_split(capacity), PACKED)


def fill_container(sizes_left: "_Sizes", capacity: int) -> list[int]:
    """Sizes for the next container, taken out of ``sizes_left``."""
    first = sizes_left.at_most(capacity)
    sizes_left.take(first)
    chosen, gap = [first], capacity - first
    while gap and (s := sizes_left.at_most(gap)):
        sizes_left.take(s)
        chosen.append(s)
        gap -= s
    if gap:
        smallest = chosen[-1]  # sizes were taken in falling order
        pair = sizes_left.best_pair(gap + smallest)
        if pair and sum(pair) > smallest:
            chosen.pop()
            sizes_left.put(smallest)
            for s in pair:
                sizes_left.take(s)
                chosen.append(s)
    return chosen


class _Sizes:
    """A multiset of sizes from 1 to ``capacity`` with predecessor search on a bit mask."""

    def __init__(self, sizes: np.ndarray, capacity: int) -> None:
        self.count = np.bincount(sizes, minlength=capacity + 1)
        self.has = self.count > 0
        self.mask = sum(1 << int(s) for s in np.flatnonzero(self.has))

    def at_most(self, x: int) -> int:
        """The largest size up to ``x``, or 0."""
        return max(0, (self.mask & ((2 << x) - 1)).bit_length() - 1)

    def take(self, s: int) -> None:
        self.count[s] -= 1
        if not self.count[s]:
            self.has[s] = False
            self.mask ^= 1 << s

    def put(self, s: int) -> None:
        self.count[s] += 1
        self.has[s] = True
        self.mask |= 1 << s

    def best_pair(self, room: int) -> tuple[int, int] | None:
        """Two sizes whose sum comes closest to ``room`` from below."""
        there = np.flatnonzero(self.has[:room])
        if not len(there):
            return None
        partner = np.searchsorted(there, room - there, "right") - 1
        alone = (partner == np.arange(len(there))) & (self.count[there] < 2)
        partner -= alone
        total = np.where(partner >= 0, there + there[partner], 0)
        best = int(total.argmax())
        return (int(there[best]), int(there[partner[best]])) if total[best] else None


def _pack_split(capacity: int):
    def pack_chunk(batches: list[pa.RecordBatch], container: int) -> tuple[pa.RecordBatch, int]:
        t = pa.Table.from_batches(batches).combine_chunks()
        size = t["size"].to_numpy()
        full, rest = np.divmod(size, capacity)
        # Full pieces, a container each.
        doc = np.repeat(np.arange(len(size)), full)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
        parts = [(container + np.arange(len(doc)), doc, piece, np.full(len(doc), capacity))]
        container += len(doc)
        # The rest, by size: documents of a size are handed out in turn.
        small = np.flatnonzero(rest)
        by_size = small[np.argsort(rest[small], kind="stable")]
        following = np.searchsorted(rest[by_size], np.arange(capacity + 1))
        left = _Sizes(rest[small], capacity)
        at, docs = [], []
        while left.mask:
            for s in fill_container(left, capacity):
                at.append(container)
                docs.append(by_size[following[s]])
                following[s] += 1
            container += 1
        if docs:
            docs = np.array(docs)
            parts.append((np.array(at), docs, full[docs], rest[docs]))
        none = np.flatnonzero(size == 0)
        parts.append((np.full(len(none), -1), none, np.zeros(len(none), np.int64), np.zeros(len(none), np.int64)))
        at, doc, piece, length = (np.concatenate([p[i] for p in parts]) for i in range(4))
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(at, pa.int64(), mask=at < 0),
                t["doc_id"].combine_chunks().take(pa.array(doc, pa.int64())),
                pa.array(piece.astype(np.int32)),
                pa.array(piece.astype(np.int64) * capacity),
                pa.array(length.astype(np.int64)),
            ],
            ["container", "doc_id", "piece", "start", "length"],
        )
        return out, container

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        container, held, n = TaskContext.get().partitionId() << 40, [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= CHUNK_DOCS:
                out, container = pack_chunk(held, container)
                yield out
                held, n = [], 0
        if n:
            yield pack_chunk(held, container)[0]

    return run
