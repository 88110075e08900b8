"""Joins beyond ``DataFrame.join``: algorithm hints, as-of, interval and grid joins, top rows per key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.sources.storage import materialize

#: Names of join algorithms and the hints that ask Spark for them.
ALGORITHMS = {"HASH": "shuffle_hash", "MERGE": "merge", "NESTED_LOOP": "shuffle_replicate_nl", "INDEX": "broadcast", "BROADCAST": "broadcast", "AUTO": None}


#: Largest side, by Spark's estimate, that a request for a broadcast join may broadcast.
BROADCAST_BYTES = 256 * 1024 * 1024

#: Largest product of both sides' bytes, by Spark's estimate, for which a request for nested loops may compare every pair: as of two
#: sides of 128 KiB.
NESTED_LOOP_PRODUCT = (128 * 1024) ** 2


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of a result; without statistics it is the size of the files read, or larger."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def equi_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str = "inner", algorithm: str = "AUTO") -> DataFrame:
    """Equi-join with an optional algorithm; null keys never match.

    Columns that both sides have get the prefix ``right_`` on the right, so no
    column is ambiguous. ``AUTO`` leaves the choice to Spark and its size checks.
    ``BROADCAST`` and ``INDEX`` broadcast the right side if it is estimated at
    ``BROADCAST_BYTES`` or less, else they leave the choice to Spark. ``NESTED_LOOP``
    compares every pair, so it does the same beyond ``NESTED_LOOP_PRODUCT``; the rows
    are the same either way. Semi and anti joins keep the left columns only.
    """
    names = {c: f"right_{c}" if c in left.columns else c for c in right.columns}
    renamed = right.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    hint = ALGORITHMS[algorithm.upper()]
    if hint == "broadcast":
        fits = estimated_bytes(renamed) <= BROADCAST_BYTES
    elif hint == "shuffle_replicate_nl":
        fits = estimated_bytes(left) * estimated_bytes(renamed) <= NESTED_LOOP_PRODUCT
    else:
        fits = True
    if hint and fits:
        renamed = renamed.hint(hint)
    cond = reduce(Column.__and__, [left[a] == renamed[names[b]] for a, b in on])
    return left.join(renamed, cond, how)


def not_in(left: DataFrame, right: DataFrame, on: tuple[str, str]) -> DataFrame:
    """Left rows whose key is NOT IN the right column, with SQL's nulls, as an anti join that may be shuffled.

    Spark's own NOT IN broadcasts the right column whatever its size. Here a count of
    its nulls comes first, -1 if it is empty: over an empty right side every left row
    is kept, over one with a null none is, and else the left rows with a key that is
    not null and has no equal; the others are dropped before the shuffle. The right
    keys are made distinct where they are read, so a hot one sends a row a split.
    """
    key = f"`{on[0]}`"
    values = right.select(F.col(f"`{on[1]}`").alias("value_"))
    rows, known = F.count(F.lit(1)), F.count("value_")
    nulls = values.agg(F.when(rows == 0, -1).otherwise(rows - known).alias("nulls_")).scalar()
    rest, values = left.where(nulls <= F.when(F.col(key).isNotNull(), 0).otherwise(-1)), values.distinct()
    return rest.join(values, rest[key] == values["value_"], "left_anti")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """To each left row, ``values`` of the right row with the latest time at or before the left time.

    Both sides are merged and sorted once per key, and the last right row is
    carried forward, so a key costs its rows and never their product. Left rows
    without an earlier right row keep nulls. Rows with a null key or time match
    nothing and are kept on the left. Of right rows at one time, the highest
    values win. The result has the left columns and ``values``, which must be new names.
    """
    keys = [F.col(k) for k in by]
    ok = reduce(Column.__and__, [k.isNotNull() for k in keys], F.lit(True))
    row = F.struct(*left.columns)
    a = left.select(*by, F.col(left_time).alias("at_"), F.lit(1).alias("side_"), row.alias("row_"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("hit_"))
    b = right.where(ok & F.col(right_time).isNotNull()).select(*by, F.col(right_time).alias("at_"), F.lit(0).alias("side_"), F.lit(None).cast(a.schema["row_"].dataType).alias("row_"), F.struct(*values).alias("hit_"))
    w = Window.partitionBy(*by).orderBy("at_", "side_", "hit_").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last("hit_", ignorenulls=True).over(w)
    usable = ok & F.col("at_").isNotNull()
    merged = a.unionByName(b).withColumn("seen_", F.when(usable, seen)).where("side_ = 1")
    return merged.select("row_.*", *(F.col(f"seen_.{v}").alias(v) for v in values))


def range_lookup(points: DataFrame, key: str, starts: DataFrame, start: str, values: Sequence[str]) -> DataFrame:
    """To each point, ``values`` of the range with the greatest start at or before it; null before the first start or for a null key.

    Points and starts are range-partitioned together, so neither side is collected
    and many points at one place are spread out. The last start of each partition is carried on
    to the next ones by a table of one row a partition. Of equal starts, the highest values win.
    ``values`` must be new names.
    """
    hit_type = starts.select(F.struct(*values)).schema[0].dataType
    row = F.struct(*(F.col(f"`{c}`") for c in points.columns))
    a = points.select(F.col(key).alias("at_"), F.lit(1).alias("side_"), F.xxhash64(F.to_json(row), F.lit(1)).alias("salt_"), row.alias("row_"), F.lit(None).cast(hit_type).alias("hit_"))
    b = starts.where(F.col(start).isNotNull()).select(
        F.col(start).alias("at_"), F.lit(0).alias("side_"), F.lit(0).cast("long").alias("salt_"), F.lit(None).cast(a.schema["row_"].dataType).alias("row_"), F.struct(*values).alias("hit_")
    )
    # Written once, so that both passes see the same partitions.
    placed = materialize(a.unionByName(b).repartitionByRange("at_", "side_", "salt_").withColumn("pid_", F.spark_partition_id()), "ranges")
    last = placed.where("side_ = 0").groupBy("pid_").agg(F.max_by("hit_", F.struct("at_", "hit_")).alias("last_"))
    pids = placed.select("pid_").distinct().join(last, "pid_", "left")  # one row a partition
    earlier = Window.partitionBy(F.lit(0)).orderBy("pid_").rowsBetween(Window.unboundedPreceding, -1)
    carried = pids.select("pid_", F.last("last_", ignorenulls=True).over(earlier).alias("carried_"))
    here = Window.partitionBy("pid_").orderBy("at_", "side_", "hit_").rowsBetween(Window.unboundedPreceding, 0)
    seen = placed.withColumn("seen_", F.last("hit_", ignorenulls=True).over(here)).where("side_ = 1").join(F.broadcast(carried), "pid_")
    found = F.when(F.col("at_").isNotNull(), F.coalesce("seen_", "carried_"))
    return seen.withColumn("found_", found).select("row_.*", *(F.col(f"found_.{v}").alias(v) for v in values))


def interval_join(points: DataFrame, key: str, ranges: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Pairs with ``low <= key < high`` by an equi-join on buckets of ``width``.

    A range goes to every bucket it touches and a point to one, so each pair is
    found once. Choose ``width`` near the usual length of a range. Nulls match nothing.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    p = points.withColumn("bucket_", bucket(key))
    r = ranges.where(F.col(low) < F.col(high)).withColumn("bucket_", F.explode(F.sequence(bucket(low), bucket(high))))
    return p.join(r, "bucket_").where((F.col(key) >= F.col(low)) & (F.col(key) < F.col(high))).drop("bucket_")


def top_per_key(left: DataFrame, right: DataFrame, on: tuple[str, str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` right rows of each left row by ``order`` (LATERAL ... LIMIT n); left rows without a match are dropped.

    Right rows are cut to ``n`` a key before the join.
    """
    rank = F.row_number().over(Window.partitionBy(on[1]).orderBy(*order))
    best = right.withColumn("rank_", rank).where(F.col("rank_") <= n).drop("rank_")
    return equi_join(left, best, [on])
