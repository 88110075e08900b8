"""Key-value logs, replicated data types and codecs as aggregates and windows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.text import glob_to_regex


def latest_per_key(log: DataFrame, key: str, order: Sequence[str], deleted: Column | None = None) -> DataFrame:
    """The last entry of every key by ``order``, without keys whose last entry is a deletion.

    One aggregation with map-side combine, so a hot key costs one value per task.
    """
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("e_")).select(key, "e_.*").select(*log.columns)
    return last if deleted is None else last.where(~F.coalesce(deleted, F.lit(False)))


def alive(entries: DataFrame, expires_at: str, now: Column) -> DataFrame:
    """Entries that have not expired; a null expiry never does."""
    return entries.where(F.col(expires_at).isNull() | (F.col(expires_at) > now))


def get_many(entries: DataFrame, key: str, keys: Sequence[object]) -> DataFrame:
    return entries.where(F.col(key).isin(*keys)) if keys else entries.limit(0)


def scan(entries: DataFrame, key: str, cursor: int = 0, pattern: str | None = None, count: int = 10) -> DataFrame:
    """A page of keys in key order that match a shell pattern."""
    found = entries if pattern is None else entries.where(F.col(key).rlike(glob_to_regex(pattern)))
    return found.orderBy(key).offset(cursor).limit(count)


def lww_merge(ops: DataFrame, element: str, stamp: Sequence[str], removed: str) -> DataFrame:
    """Last-writer-wins set: elements whose last operation by ``stamp`` (time, counter, node) is no removal."""
    last = ops.groupBy(element).agg(F.max_by(removed, F.struct(*stamp)).alias("gone_"))
    return last.where(~F.col("gone_")).select(element)


def or_set(adds: DataFrame, removes: DataFrame, element: str, tag: str) -> DataFrame:
    """Observed-remove set: elements with an added tag that was not removed."""
    return adds.join(removes.select(element, tag).distinct(), [element, tag], "left_anti").select(element).distinct()


def g_counter(states: DataFrame, counter: str, node: str, value: str) -> DataFrame:
    """Grow-only counter: the sum over nodes of the highest value seen of each."""
    per_node = states.groupBy(counter, node).agg(F.max(value).alias("m_"))
    return per_node.groupBy(counter).agg(F.sum("m_").alias("total"))


def pn_counter(states: DataFrame, counter: str, node: str, up: str, down: str) -> DataFrame:
    """Counter with increments and decrements: difference of two grow-only counters."""
    per_node = states.groupBy(counter, node).agg(F.max(up).alias("u_"), F.max(down).alias("d_"))
    return per_node.groupBy(counter).agg((F.sum("u_") - F.sum("d_")).alias("total"))


def compare_clocks(a: Column, b: Column) -> Column:
    """1 if ``a`` is after ``b``, -1 if before, 0 if equal or concurrent; maps of node to count, absent nodes are 0."""
    nodes = F.array_distinct(F.concat(F.map_keys(a), F.map_keys(b)))
    at = lambda m, n: F.coalesce(F.try_element_at(m, n), F.lit(0))
    ahead = F.exists(nodes, lambda n: at(a, n) > at(b, n))
    behind = F.exists(nodes, lambda n: at(a, n) < at(b, n))
    return F.when(ahead & ~behind, 1).when(behind & ~ahead, -1).otherwise(0)


def set_if(entries: DataFrame, writes: DataFrame, key: str, mode: str = "") -> DataFrame:
    """Entries after writes of whole rows: all of them, only new keys (``NX``) or only keys that are there (``XX``).

    ``writes`` has one row a key. Null keys are never there.
    """
    if mode.upper() not in ("", "NX", "XX"):
        raise ValueError(f"unknown mode {mode}")
    there = entries.select(F.col(key).alias("there_")).distinct()
    if mode:
        writes = writes.join(there, F.col(key) == F.col("there_"), "left_anti" if mode.upper() == "NX" else "left_semi")
    kept = entries.join(writes.select(F.col(key).alias("new_")), F.col(key) == F.col("new_"), "left_anti")
    return kept.unionByName(writes.select(*entries.columns))


def cleanup_before(log: DataFrame, deleted: Column, time: str, before: Column) -> DataFrame:
    """The log without deletions older than ``before``; those with a null time stay."""
    return log.where(~F.coalesce(deleted & (F.col(time) < before), F.lit(False)))


def quorum_read(answers: DataFrame, key: str, replica: str, value: str, version: str, quorum: int) -> DataFrame:
    """The newest value of each key for which at least ``quorum`` different replicas answered.

    A replica that answers several times counts once; answers of a null replica count for none.
    """
    newest = F.max_by(F.col(value), F.col(version))
    per_replica = answers.where(F.col(replica).isNotNull()).groupBy(key, replica).agg(newest.alias(value), F.max(version).alias(version))
    seen = per_replica.groupBy(key).agg(newest.alias(value), F.max(version).alias(version), F.count(F.lit(1)).alias("n_"))
    return seen.where(F.col("n_") >= quorum).drop("n_")


def run_lengths(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Runs of equal neighbouring values: ``by..., run, value, n, first_, last_`` with the first and last order key."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    run = F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        df.withColumn("new_", new)
        .withColumn("run", run)
        .groupBy(*by, "run", value)
        .agg(F.count(F.lit(1)).alias("n"), F.min(order[0]).alias("first_"), F.max(order[0]).alias("last_"))
    )


def expand_runs(runs: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The values of runs one by one, with their place in the run."""
    return runs.select(*by, "run", value, F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("place"))


def deltas(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, times: int = 1) -> DataFrame:
    """Differences to the row before, taken once or more often; the first rows of a group keep nulls."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("delta", F.col(value))
    for _ in range(times):
        out = out.withColumn("delta", F.col("delta") - F.lag("delta").over(w))
    return out


def undo_deltas(df: DataFrame, by: Sequence[str], order: Sequence[str], first: str, delta: str) -> DataFrame:
    """Values back from first values and differences."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("value", F.first(first).over(w) + F.sum(F.coalesce(delta, F.lit(0))).over(w))


def xor_with_previous(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """``bits`` of a double XOR those of the row before (0 for the first): runs of equal values become zeros."""
    @F.pandas_udf("long")
    def xor(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (s.fillna(0.0).to_numpy(np.float64).view(np.int64) for s in (a, b))
        return pd.Series(np.where(b.isna(), x, x ^ y))

    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("before_", F.lag(value).over(w)).withColumn("bits", xor(F.col(value), F.col("before_"))).drop("before_")


def last_messages(messages: DataFrame, channel: str, order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` messages of every channel with ``place`` 1 for the newest."""
    w = Window.partitionBy(channel).orderBy(*(F.col(c).desc() for c in order))
    return messages.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
