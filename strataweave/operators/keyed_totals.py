"""Totals per key that stay balanced when a few keys hold most rows.

Every input split dictionary-encodes its keys and counts the codes with
``numpy.bincount``, so a key, however frequent, leaves a split as one number.
The numbers travel in array blocks of ``BLOCK`` neighbouring keys and are summed
block by block in dense accumulators; where blocks are thin, as with hashed keys,
their cells are summed by position instead. What a task gets depends on the number
of splits and keys, not on how often a key occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1024
CHUNK_ROWS = 1_000_000
#: Rows of blocks that are summed together, and one in so many cells used below which a dense array does not pay.
ROWS_AT_ONCE = 2_000
THIN = 32
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def keyed_totals(df: DataFrame, group: str, key: str, values: tuple[str, ...] = ()) -> DataFrame:
    """Rows and value sums per ``group`` and integral ``key``: ``group, key, n_rows, sum_<value>...``.

    All rows count, repeated ones too. A null group or key makes its own total;
    null values add nothing, and a sum over nulls alone is 0. Values are integral and
    sums exact; one beyond 64 bits is an error. Other columns are not read, whatever
    their names. An empty table gives no rows.
    """
    for name in (key, *values):
        if not isinstance(df.schema[name].dataType, _INTEGRAL):
            raise TypeError(f"{name} must be integral; use groupBy().sum() for other types")
    g_type, k_type = df.schema[group].dataType, df.schema[key].dataType
    rows = df.select(
        F.col(group).alias("g"), F.col(key).cast("long").alias("k"), *(F.col(v).cast("long").alias(f"v{i}") for i, v in enumerate(values))
    )
    width = 1 + len(values)
    partial = T.StructType(
        [
            T.StructField("g", g_type),
            T.StructField("block", T.LongType()),
            T.StructField("offsets", T.BinaryType()),
            T.StructField("sums", T.BinaryType()),
        ]
    )
    total = T.StructType(
        [T.StructField(group, g_type), T.StructField(key, T.LongType()), T.StructField("n_rows", T.LongType())]
        + [T.StructField(f"sum_{v}", T.LongType()) for v in values]
    )
    blocks = rows.mapInArrow(_count_splits(width), partial)
    summed = (
        blocks.repartition("g", "block").sortWithinPartitions("g", "block").mapInArrow(_sum_blocks(width, total.fieldNames()), total)
    )
    return summed.withColumn(key, F.col(key).cast(k_type))


def _count_splits(width: int):
    """Arrow batches of a split -> rows of (group, block, offsets, sums) per million input rows."""

    def count(chunk: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(chunk).combine_chunks()
        g = pc.dictionary_encode(t["g"], null_encoding="encode").combine_chunks()
        if isinstance(g, pa.ChunkedArray):
            g = g.chunk(0)
        g_codes = g.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        empty = pc.is_null(t["k"]).to_numpy(zero_copy_only=False).astype(bool)
        keys, k_codes = np.unique(pc.fill_null(t["k"], 0).to_numpy(), return_inverse=True)
        k_codes = np.where(empty, len(keys), k_codes)  # the code after the last key stands for null
        cells, codes = np.unique(g_codes * (len(keys) + 1) + k_codes, return_inverse=True)
        sums = np.empty((len(cells), width), np.int64)
        sums[:, 0] = np.bincount(codes, minlength=len(cells))
        for i in range(1, width):
            sums[:, i] = _exact_sums(codes, pc.fill_null(t[f"v{i - 1}"], 0).to_numpy(), len(cells))
        g_of, k_of = np.divmod(cells, len(keys) + 1)
        null_key = k_of == len(keys)
        key = np.where(null_key, 0, keys[np.minimum(k_of, len(keys) - 1)])
        block, offset = key // BLOCK, (key % BLOCK).astype(np.uint16)
        # Sorted by group, then key: equal (group, block) are neighbours, and the null key comes last.
        new = np.flatnonzero(np.r_[True, (g_of[1:] != g_of[:-1]) | (block[1:] != block[:-1]) | null_key[1:]])
        return _packed(g.dictionary.take(pa.array(g_of[new])), pa.array(block[new], pa.int64(), mask=null_key[new]), np.r_[new, len(cells)], offset, sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, n = [], 0
        for b in batches:
            if b.num_rows:
                chunk.append(b)
                n += b.num_rows
            if n >= CHUNK_ROWS:
                yield count(chunk)
                chunk, n = [], 0
        if n:
            yield count(chunk)

    return run


def _exact_sums(codes: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit integers by code. The halves of the numbers are summed apart, in doubles that hold them exactly."""
    low = np.bincount(codes, weights=v & 0xFFFFFFFF, minlength=n).astype(np.int64)
    high = np.bincount(codes, weights=v >> 32, minlength=n).astype(np.int64) + (low >> 32)
    if len(high) and (high.max() >= 2**31 or high.min() < -(2**31)):
        raise OverflowError("a sum does not fit into 64 bits")
    return (high << 32) + (low & 0xFFFFFFFF)


def _packed(g: pa.Array, block: pa.Array, starts: np.ndarray, offset: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """Rows (group, block, offsets, sums); row ``i`` has the cells from ``starts[i]`` to ``starts[i + 1]``."""

    def binary(cells: np.ndarray, size: int) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * size).astype(np.int32).tobytes()), pa.py_buffer(cells.tobytes())])

    return pa.RecordBatch.from_arrays([g, block, binary(offset.astype(np.uint16), 2), binary(sums, 8 * sums.shape[1])], ["g", "block", "offsets", "sums"])


def _cells(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed cells end to end, and how many each row has."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(column) and column.buffers()[2] else np.zeros(0, np.uint8)
    return data.copy().view(kind), np.diff(ends) // np.dtype(kind).itemsize


def _sum_blocks(width: int, names: list[str]):
    """Rows sorted by (group, block) -> totals. The last block of a batch may go on in the next one and is held back."""

    def add_up(b: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
        """One row for each (group, block), with starts, offsets and sums of its cells."""
        g = b["g"].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        none = b["block"].is_null().to_numpy(zero_copy_only=False).astype(bool)
        block = pc.fill_null(b["block"], 0).to_numpy()
        new = np.r_[True, (g[1:] != g[:-1]) | (block[1:] != block[:-1]) | (none[1:] != none[:-1])]
        ordinal = np.cumsum(new) - 1
        offset, n = _cells(b["offsets"], np.uint16)
        sums = _cells(b["sums"], np.int64)[0].reshape(-1, width)
        cell = np.repeat(ordinal, n) * BLOCK + offset
        n_blocks = int(ordinal[-1]) + 1
        if len(cell) * THIN >= n_blocks * BLOCK:
            dense = np.stack([_exact_sums(cell, sums[:, i], n_blocks * BLOCK) for i in range(width)], 1)
            used = np.flatnonzero(dense[:, 0])
            total = dense[used]
        else:
            used, at = np.unique(cell, return_inverse=True)
            total = np.stack([_exact_sums(at, sums[:, i], len(used)) for i in range(width)], 1)
        first = b.take(pa.array(np.flatnonzero(new)))
        return first, np.searchsorted(used // BLOCK, np.arange(n_blocks + 1)), used % BLOCK, total

    def totals(first: pa.RecordBatch, starts: np.ndarray, offset: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        row = np.repeat(np.arange(first.num_rows), np.diff(starts))
        key = pc.fill_null(first["block"], 0).to_numpy()[row] * BLOCK + offset
        none = first["block"].is_null().to_numpy(zero_copy_only=False).astype(bool)[row]
        columns = [first["g"].take(pa.array(row)), pa.array(key, pa.int64(), mask=none), *(pa.array(np.ascontiguousarray(sums[:, i])) for i in range(width))]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(at, ROWS_AT_ONCE)
                if held is not None:
                    b = pa.Table.from_batches([held, b.cast(held.schema)]).combine_chunks().to_batches()[0]
                first, starts, offset, sums = add_up(b)
                last = first.num_rows - 1
                if last:
                    yield totals(first.slice(0, last), starts[: last + 1], offset[: starts[last]], sums[: starts[last]])
                cut = starts[last]
                held = _packed(first["g"].slice(last), first["block"].slice(last), starts[last:] - cut, offset[cut:], sums[cut:])
        if held is not None:
            yield totals(*add_up(held))

    return run
