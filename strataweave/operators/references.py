"""Orphan references: keys that were missing, deleted or not yet loaded when referred to.

The parent side becomes disjoint intervals in which a key is alive. Distinct
foreign keys are anti-joined against them first: a key that is alive over its
whole span of use has no orphans. The keys that remain are joined back to their
rows, which are tested one by one. Intervals and keys are written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.sources.storage import materialize

HOT_SHARE = 0.001
#: Rows of a hot key that are joined in one piece.
ROWS_PER_SALT = 100_000
#: Keys to be joined back, or intervals of hot keys, that may be broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 200_000


def alive_intervals(loads: DataFrame, deletions: DataFrame | None = None) -> DataFrame:
    """Intervals ``[alive_from, alive_to)`` of each key; ``alive_to`` is null where it is still alive.

    Both inputs have a key and a timestamp as their first two columns; further
    columns are ignored. Rows with a null key or time count for nothing. Repeated
    rows count once. A deletion at the very time of a load comes after it. An
    empty input gives no intervals.
    """
    loaded, deleted = loads.columns, deletions.columns if deletions is not None else []
    events = loads.select(loads[loaded[0]].alias("parent_key"), loads[loaded[1]].alias("at"), F.lit(1).alias("alive"))
    if deletions is not None:
        gone = deletions.select(
            deletions[deleted[0]].alias("parent_key"), deletions[deleted[1]].alias("at"), F.lit(0).alias("alive")
        )
        events = events.unionByName(gone)
    # One row per key and time, and of neighbouring events of a day that say the same only the first, so that
    # a key that is loaded over and over leaves few rows for the order over its whole history.
    events = events.where("parent_key is not null and at is not null").withColumn("day", F.date_trunc("day", "at"))
    events = events.repartition("parent_key", "day").groupBy("parent_key", "day", "at").agg(F.min("alive").alias("alive"))
    turns = _turns(_turns(events, "parent_key", "day"), "parent_key").where("alive = 1 or before is not null")
    return (
        turns.withColumn("alive_to", F.lead("at").over(Window.partitionBy("parent_key").orderBy("at")))
        .where("alive = 1")
        .select("parent_key", F.col("at").alias("alive_from"), "alive_to")
    )


def _turns(events: DataFrame, *by: str) -> DataFrame:
    """Events that say something else than the one before them in their group; ``before`` is null for a group's first."""
    w = Window.partitionBy(*by).orderBy("at")
    return events.withColumn("before", F.lag("alive").over(w)).where("before is null or alive <> before")


def _alive(ref_ts: str) -> Column:
    return (F.col("alive_from") <= F.col(ref_ts)) & (F.col("alive_to").isNull() | (F.col(ref_ts) < F.col("alive_to")))


def orphan_references(
    child: DataFrame, child_id: str, key: str, ref_ts: str | Column, intervals: DataFrame, hot_share: float = HOT_SHARE
) -> DataFrame:
    """Rows of ``child`` whose reference is not null and not alive at its reference time.

    Returns ``child_id, ref_key, ref_ts``, one row per delivered row, repeated
    rows included. A null key is no reference. A null reference time lies in no
    interval, so such a row is an orphan. Other columns of ``child`` are not read.
    An empty child gives no rows; with no intervals every reference is an orphan.

    Keys with at least ``hot_share`` of the rows are at most ``1 / hot_share``.
    Rows of those that are always alive are dropped where they are read; rows of
    the others meet a broadcast of the intervals of these keys, or are joined in
    pieces of ``ROWS_PER_SALT`` rows where the intervals are many. Runs jobs when called.
    """
    at = F.col(ref_ts) if isinstance(ref_ts, str) else ref_ts
    refs = child.select(F.col(child_id).alias("child_id"), F.col(key).alias("ref_key"), at.alias("ref_ts")).where(
        F.col("ref_key").isNotNull()
    )
    intervals = materialize(intervals, "intervals")
    least = max(1.0, hot_share * child.count())
    checked = materialize(_checked_keys(refs, intervals, least), "keys")
    is_frequent = F.when((F.col("n_refs") >= least) & F.lit(least > 1), F.struct("ref_key", "suspect", "n_refs"))
    n_suspects, frequent = checked.agg(F.count_if("suspect"), F.collect_list(is_frequent)).first()
    hot = {r["ref_key"]: r["suspect"] for r in frequent}
    split = {r["ref_key"]: r["n_refs"] for r in frequent if r["suspect"]}
    is_hot = lambda c: F.col(c).isin(list(hot)) if hot else F.lit(False)

    suspects = checked.where(F.col("suspect") & ~is_hot("ref_key")).select(F.col("ref_key").alias("suspect_key"))
    spans = intervals.where(~is_hot("parent_key"))
    if n_suspects <= BROADCAST_KEYS:
        suspects = F.broadcast(suspects)
        spans = spans.join(suspects, F.col("parent_key") == F.col("suspect_key"), "left_semi")
    rows = refs.where(~is_hot("ref_key")).join(suspects, F.col("ref_key") == F.col("suspect_key"), "left_semi")
    cold = rows.join(spans, (F.col("ref_key") == F.col("parent_key")) & _alive("ref_ts"), "left_anti")
    if not split:
        return cold
    heavy, spans = refs.where(F.col("ref_key").isin(list(split))), intervals.where(F.col("parent_key").isin(list(split)))
    inside = (F.col("ref_key") == F.col("parent_key")) & _alive("ref_ts")
    if spans.count() <= BROADCAST_KEYS:
        return cold.unionByName(heavy.join(F.broadcast(spans), inside, "left_anti"))
    salts = -(-max(split.values()) // ROWS_PER_SALT)
    heavy = heavy.withColumn("salt", F.pmod(F.xxhash64("child_id", "ref_ts"), F.lit(salts)))
    spans = spans.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return cold.unionByName(heavy.join(spans, inside & (F.col("salt") == F.col("piece")), "left_anti").drop("salt"))


def _checked_keys(refs: DataFrame, intervals: DataFrame, least: float) -> DataFrame:
    """``ref_key, n_refs, suspect`` of the keys that are not alive over their whole span of use, and of those with ``least`` rows."""
    keys = refs.groupBy("ref_key").agg(
        F.min("ref_ts").alias("first_ts"),
        F.max("ref_ts").alias("last_ts"),
        F.count(F.lit(1)).alias("n_refs"),
        F.count("ref_ts").alias("n_times"),
    )
    covered = (
        (F.col("ref_key") == F.col("parent_key"))
        & (F.col("n_refs") == F.col("n_times"))
        & (F.col("alive_from") <= F.col("first_ts"))
        & (F.col("alive_to").isNull() | (F.col("last_ts") < F.col("alive_to")))
    )
    # An anti-join that keeps the hot keys besides; intervals of a key are disjoint, so at most one covers its span.
    joined = keys.join(intervals, covered, "left").select("ref_key", "n_refs", F.col("parent_key").isNull().alias("suspect"))
    return joined.where(F.col("suspect") | (F.col("n_refs") >= least)) if least > 1 else joined.where("suspect")


def orphan_counts(child: DataFrame, key: str, ref_ts: str | Column, orphans: DataFrame, period: str = "month") -> DataFrame:
    """References and orphans per period: ``period, n_refs, n_orphans, orphan_share``.

    Rows without a key are no references. A null time makes its own period.
    """
    at = F.col(ref_ts) if isinstance(ref_ts, str) else ref_ts
    all_refs = (
        child.where(F.col(key).isNotNull())
        .select(F.date_trunc(period, at).alias("period"))
        .groupBy("period")
        .agg(F.count(F.lit(1)).alias("n_refs"))
    )
    lost = (
        orphans.select(F.date_trunc(period, F.col("ref_ts")).alias("period_"))
        .groupBy("period_")
        .agg(F.count(F.lit(1)).alias("n_lost"))
    )
    n = F.coalesce(F.col("n_lost"), F.lit(0))
    return all_refs.join(lost, F.col("period").eqNullSafe(F.col("period_")), "left").select(
        "period", "n_refs", n.alias("n_orphans"), (n / F.col("n_refs")).alias("orphan_share")
    )
