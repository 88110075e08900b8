"""The N best rows of every group by a secondary sort.

Rows are sorted by group, score and identifier and streamed as Arrow batches;
only the number of rows already passed on of the current group is remembered.
Every input split is cut down to N rows a group before anything is shuffled, so
a group of any size sends at most N rows per split to the task that finishes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def top_n(df: DataFrame, group: str, score: str, ident: str, n: int) -> DataFrame:
    """The ``n`` rows of each group with the highest score; of equal scores the smaller ``ident`` first.

    Returns ``group, ident, score`` and ``rank`` (1 to ``n``). Rows with a null
    group or score cannot be ranked and are left out; a null ``ident`` comes after
    all others; NaN scores count as highest, as Spark sorts them. Repeated rows
    each take a place. Groups with fewer than ``n`` rows return all of them. Other
    columns are not read, whatever their names. An empty table gives no rows.
    """
    rows = df.select(F.col(group).alias("g"), F.col(ident).alias("i"), F.col(score).alias("s")).where("g is not null and s is not null")
    order = [F.col("g"), F.col("s").desc(), F.col("i").asc_nulls_last()]
    kept = rows.sortWithinPartitions(*order).mapInArrow(_first(n), rows.schema)
    ranked = kept.repartition("g").sortWithinPartitions(*order).mapInArrow(_first(n, ranks=True), _with(kept.schema, "rank", T.IntegerType()))
    return ranked.select(F.col("g").alias(group), F.col("i").alias(ident), F.col("s").alias(score), "rank")


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, kind)])


def _first(n: int, ranks: bool = False):
    """Batches sorted by ``g`` -> the first ``n`` rows of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, taken = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g = b["g"]
            new = np.ones(b.num_rows, bool)
            new[1:] = pc.fill_null(pc.not_equal(g[1:], g[:-1]), True).to_numpy(zero_copy_only=False)
            new[0] = last is None or g[0] != last
            starts = np.flatnonzero(new)
            at = np.arange(b.num_rows)
            place = at - np.maximum.accumulate(np.where(new, at, 0))
            if not new[0]:  # the group goes on from the batch before
                end = int(starts[0]) if len(starts) else b.num_rows
                place[:end] = np.arange(end) + taken
            keep = place < n
            last = g[b.num_rows - 1]
            taken = int(place[-1]) + 1
            out = b.filter(pa.array(keep))
            if ranks:
                out = pa.RecordBatch.from_arrays([*out.columns, pa.array(place[keep] + 1, pa.int32())], [*out.schema.names, "rank"])
            if out.num_rows:
                yield out

    return run
