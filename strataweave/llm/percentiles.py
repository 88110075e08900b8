"""Exact percentiles per group by one distributed sort.

Equal values of a group are first merged into one row with a count. That table
is exact, can be merged with those of other partitions, loads or days
(:func:`merge_states`), and has no value that holds more than one row, so a range
sort splits groups of any size evenly. Counts per sorted partition give each
group's offsets; the wanted positions are located by partition and read off.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataweave.sources.storage import materialize


def value_state(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """The mergeable state ``groups..., value, n``: rows per group and value.

    Null values are left out, NaN is left out (it has no order among numbers);
    null group keys form a group. Repeated rows count each time.
    """
    v = F.col(value)
    rows = df.select(*groups, v.alias("value")).where(v.isNotNull())
    if dict(df.dtypes)[value] in ("double", "float"):
        rows = rows.where(~F.isnan("value"))
    return rows.groupBy(*groups, "value").agg(F.count(F.lit(1)).alias("n"))


def merge_states(*states: DataFrame) -> DataFrame:
    """One state for the rows of all states, as if it had been made from them together."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy(*(c for c in out.columns if c != "n")).agg(F.sum("n").alias("n"))


def percentiles(state: DataFrame, percents: Sequence[int]) -> DataFrame:
    """``groups..., percent, n_values, lower, interpolated`` for each group of a state and each percent (0 to 100).

    ``lower`` is the smallest value with at least that share of the group's values
    at or below it; ``interpolated`` lies between the neighbouring order
    statistics (rank ``1 + p (n - 1) / 100``) as a double. Both are exact. States may be
    put together by a plain union: a value may have several rows. An empty state
    gives no rows.
    """
    groups = [c for c in state.columns if c not in ("value", "n")]
    keys = [F.col(c) for c in groups]
    value_type = state.schema["value"].dataType
    # One fixed table, so that both passes see the same partitions.
    ordered = (
        state.withColumn("gid", F.struct(*keys))
        .withColumn("gid", F.to_json("gid", {"ignoreNullFields": "false"}))
        .select(*groups, "gid", "value", "n")
        .repartitionByRange("gid", "value")
        .sortWithinPartitions("gid", "value")
        .withColumn("pid", F.spark_partition_id())
    )
    ordered = materialize(ordered.mapInArrow(_running, T.StructType([*ordered.schema.fields, T.StructField("upto", T.LongType())])), "sorted")

    sizes = ordered.groupBy("gid", "pid").agg(F.sum("n").alias("n_here"), *(F.first(c).alias(c) for c in groups))
    by_pid = Window.partitionBy("gid").orderBy("pid")  # one row per sorted partition that holds the group
    whole = Window.partitionBy("gid")
    sizes = sizes.withColumn("offset", F.sum("n_here").over(by_pid) - F.col("n_here")).withColumn("n_values", F.sum("n_here").over(whole))

    n, p = F.col("n_values"), F.col("percent")
    wanted = (
        sizes.withColumn("percent", F.explode(F.array(*(F.lit(int(x)) for x in percents))))
        .withColumn("ranks", F.array(F.greatest(F.lit(1), F.expr("(n_values * percent + 99) div 100")), 1 + F.expr("((n_values - 1) * percent) div 100"), F.least(n, 2 + F.expr("((n_values - 1) * percent) div 100"))))
        .select("gid", "pid", "offset", "n_here", "n_values", "percent", *groups, F.posexplode("ranks").alias("kind", "rank"))
        .withColumn("at", F.col("rank") - F.col("offset"))
        .where("at >= 1 and at <= n_here")
        .select("gid", "pid", "percent", "kind", "n_values", "at", *groups)
    )
    values = ordered.select(F.col("gid").alias("gid_"), F.col("pid").alias("pid_"), "value", (F.col("upto") - F.col("n")).alias("below"), "upto")
    inside = (F.col("gid") == F.col("gid_")) & (F.col("pid") == F.col("pid_")) & (F.col("at") > F.col("below")) & (F.col("at") <= F.col("upto"))
    hits = wanted.join(values, inside)
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("value")))
    found = hits.groupBy("gid", "percent").agg(
        F.max("n_values").alias("n_values"), of(0).cast(value_type).alias("lower"), of(1).cast("double").alias("a"), of(2).cast("double").alias("b"), *(F.first(c).alias(c) for c in groups)
    )
    part = (F.expr("((n_values - 1) * percent) % 100") / 100).cast("double")
    return found.select(*groups, "percent", "n_values", "lower", (F.col("a") + (F.col("b") - F.col("a")) * part).alias("interpolated"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted rows the running count within their group and partition."""
    last, total = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        g = b["gid"]
        new = np.ones(b.num_rows, bool)
        new[1:] = pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)
        new[0] = last is None or g[0] != last
        n = b["n"].to_numpy()
        upto = np.cumsum(n)
        starts = np.flatnonzero(new)
        base = np.zeros(b.num_rows, np.int64)
        if len(starts):
            base = np.repeat(np.r_[0, upto[starts] - n[starts]], np.diff(np.r_[0, starts, b.num_rows]))
        upto = upto - base
        first_end = int(starts[0]) if len(starts) else b.num_rows
        upto[:first_end] += total
        last, total = g[b.num_rows - 1], int(upto[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto, pa.int64())], [*b.schema.names, "upto"])
