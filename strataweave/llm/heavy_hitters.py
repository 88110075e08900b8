"""The most frequent values of a column by a three-phase threshold algorithm.

The nodes are the input splits. Each sorts its values (Spark spills what does
not fit) and counts runs as they stream by, so a node needs memory for one
count, not for its distinct values.

1. Every node sends its ``k`` most frequent values. The ``k``-th highest sum of
   these is a lower bound for the ``k``-th highest total.
2. A value at or above the bound has at least its ``1/m`` share on one of the
   ``m`` nodes; every node sends all values above that share. What a node did not
   send is below the share, which bounds each total from above.
3. Values whose upper bound reaches the improved lower bound are counted exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataweave.sources.storage import discard, materialize

#: Candidates of phase 3 that may be broadcast; more are joined by a shuffle.
BROADCAST_CANDIDATES = 200_000

def top_k(df: DataFrame, column: str, k: int, least: int = 1) -> DataFrame:
    """The ``k`` most frequent non-null values with at least ``least`` rows and their exact counts: ``value, n_rows``.

    Of values with equal counts the smaller go first, so the result is the same
    on every run. Fewer than ``k`` distinct values return all of them. Repeated
    rows count each time; other columns are not read. An empty column gives no
    rows. Runs two small jobs when called.
    """
    values = df.select(F.col(column).alias("value")).where("value is not null")
    local = values.sortWithinPartitions("value")
    schema = T.StructType([*values.schema.fields, T.StructField("n", T.LongType()), T.StructField("node", T.IntegerType())])

    # Phase 1: local leaders give the first bound.
    bound, nodes = _bound(local.mapInArrow(_local_counts(k=k), schema), k)
    bound = max(bound, least)

    # Phase 2: everything at or above a node's share of the bound. What the nodes send is written, so all that is read
    # off it fits together. Should the data come in more splits than before, the share is smaller.
    while True:
        share = max(1, -(-bound // nodes))
        sent = materialize(local.mapInArrow(_local_counts(least=share), schema), "heavy")
        found, now = _bound(sent, k)
        if now <= nodes:
            break
        discard(sent)
        nodes = now
    seen = sent.where("n > 0").groupBy("value").agg(F.sum("n").alias("seen"), F.count(F.lit(1)).alias("on"))
    most = F.col("seen") + (F.lit(nodes) - F.col("on")) * F.lit(share - 1)
    candidates = seen.where(most >= max(bound, found)).select("value")

    # Phase 3: exact counts of what is left.
    if candidates.count() <= BROADCAST_CANDIDATES:
        candidates = F.broadcast(candidates)
    return (
        values.join(candidates, "value", "left_semi")
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_rows") >= least)
        .orderBy(F.col("n_rows").desc(), F.col("value").asc())
        .limit(k)
    )


def _bound(sent: DataFrame, k: int) -> tuple[int, int]:
    """The ``k``-th highest sum of what the nodes sent, 1 if there are fewer, and the nodes: each that had any value sends one null."""
    sums = sent.groupBy("value").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"))
    first = sums.orderBy(F.col("value").isNotNull(), F.col("n").desc()).limit(k + 1)
    r = first.agg(F.count("value"), F.min(F.when(F.col("value").isNotNull(), F.col("n"))), F.max(F.when(F.col("value").isNull(), F.col("c")))).first()
    return (int(r[1]) if r[0] == k else 1), int(r[2] or 1)


def _local_counts(k: int = 0, least: int = 1):
    """Sorted values of a split -> its ``k`` most frequent, or all with ``least`` rows: ``value, n, node``, and a row with null and 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        node = TaskContext.get().partitionId()
        value, n, kind = None, 0, None
        heap: list[tuple[int, int, object]] = []
        serial = 0

        def offer(values: list, counts: list):
            nonlocal serial
            for v, c in zip(values, counts, strict=True):
                serial += 1
                if len(heap) < k:
                    heapq.heappush(heap, (c, -serial, v))
                elif c > heap[0][0]:
                    heapq.heapreplace(heap, (c, -serial, v))

        def rows(values: pa.Array, counts) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [values, pa.array(counts, pa.int64()), pa.array(np.full(len(values), node, np.int32))], ["value", "n", "node"]
            )

        def pick(values: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            floor = heap[0][0] + 1 if k and len(heap) == k else least
            at = np.flatnonzero(counts >= floor)
            if not len(at):
                return
            chosen = values.take(pa.array(at))
            if k:
                offer(chosen.to_pylist(), counts[at].tolist())
            else:
                yield rows(chosen, counts[at])

        for b in batches:
            if not b.num_rows:
                continue
            v = b["value"]
            kind = v.type
            new = np.ones(b.num_rows, bool)
            new[1:] = pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            counts = np.diff(np.r_[starts, b.num_rows])
            if n and v[0] == value:
                counts[0] += n
            elif n:
                yield from pick(pa.array([value.as_py()], kind), np.array([n]))
            value, n = v[b.num_rows - 1], int(counts[-1])  # the last run may go on
            yield from pick(v.take(pa.array(starts[:-1])), counts[:-1])
        if n:
            yield from pick(pa.array([value.as_py()], kind), np.array([n]))
        if kind is not None:
            yield rows(pa.nulls(1, kind), [0])
        if heap:
            yield rows(pa.array([v for _, _, v in heap], kind), [c for c, _, _ in heap])

    return run
