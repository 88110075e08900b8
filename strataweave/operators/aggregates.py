"""Grouping by a specification, statistics of columns and histograms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataweave.functions.numeric import gcd_agg

AGGREGATES = {
    "COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "GCD": gcd_agg, "MEDIAN": F.median,
    "STDEV": F.stddev_samp, "COUNT_DISTINCT": F.countDistinct, "APPROX_COUNT_DISTINCT": F.approx_count_distinct,
    "ARRAY_AGG": lambda c: F.sort_array(F.collect_list(c)), "CORR": F.corr,
}


def aggregate(df: DataFrame, specs: Sequence[tuple[str, str, str]], by: Sequence[str] = (), having: Column | None = None, order: Sequence[Column] = (), limit: int | None = None) -> DataFrame:
    """Aggregates ``(function, column or *, alias)`` per group, then HAVING, ORDER BY and LIMIT.

    Without ``by`` there is one row, also for an empty table. Nulls are skipped by
    all functions but ``COUNT(*)``; null keys form a group.
    """
    columns = [(F.count(F.lit(1)) if c == "*" else AGGREGATES[f.upper()](c)).alias(name) for f, c, name in specs]
    out = df.groupBy(*by).agg(*columns)
    if having is not None:
        out = out.where(having)
    if order:
        out = out.orderBy(*order)
    return out if limit is None else out.limit(limit)


def gcd_by(df: DataFrame, by: Sequence[str], column: str, name: str = "gcd") -> DataFrame:
    """``by..., name``: GCD of the integers of each group, nulls left out; null for a group without any, one row without ``by``.

    Every split reduces its values first, in Arrow batches, so a group costs one number
    a split however many values it has. Values are 64-bit; the result is not negative.
    """
    keys = [F.col(f"`{c}`") for c in by]
    rows = df.select(F.to_json(F.struct(*keys, F.lit(0).alias("one_")), {"ignoreNullFields": "false"}).alias("gid_"), *keys, F.col(f"`{column}`").cast("long").alias("v_"))
    partial = T.StructType([*rows.schema.fields[:-1], T.StructField("v_", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            code = b["gid_"].dictionary_encode().indices.to_numpy()
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])
            v = np.abs(pc.fill_null(b["v_"], 0).to_numpy())[order]
            some = np.logical_or.reduceat(pc.is_valid(b["v_"]).to_numpy(zero_copy_only=False)[order], starts)
            first = b.take(pa.array(order[starts]))
            yield pa.RecordBatch.from_arrays([*first.columns[:-1], pa.array(np.gcd.reduceat(v, starts), pa.int64(), mask=~some)], first.schema.names)

    return rows.mapInArrow(run, partial).groupBy(*by).agg(gcd_agg("v_").alias(name))


def with_positions(df: DataFrame, order: Sequence[str], name: str = "place", descending: bool = False) -> DataFrame:
    """Rows with their position (from 0) in the order of some columns, nulls first; ties by the whole row.

    Positions are prefix sums over range partitions; rows that tie are spread out.
    """
    from strataweave.sources.storage import materialize

    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    keyed = df.select(row.alias("row"), F.struct(*(F.col(f"`{c}`") for c in order)).alias("v"), F.xxhash64(F.to_json(row)).alias("salt"))
    ordered = materialize(keyed.repartitionByRange("v", "salt").withColumn("pid", F.spark_partition_id()), "ordered")
    sizes = ordered.groupBy("pid").agg(F.count(F.lit(1)).alias("here"))  # one row a partition
    offsets = sizes.withColumn("offset", F.sum("here").over(Window.partitionBy(F.lit(0)).orderBy("pid")) - F.col("here"))
    place = F.col("offset") + F.row_number().over(Window.partitionBy("pid").orderBy("v", "salt")) - 1
    if descending:
        offsets = offsets.withColumn("total", F.sum("here").over(Window.partitionBy(F.lit(0))))
        place = F.col("total") - 1 - place
    return ordered.join(F.broadcast(offsets), "pid").withColumn("place", place).select("row.*", F.col("place").cast("long").alias(name))


def random_values(spark: SparkSession, n: int, low: float = 0.0, high: float = 1.0, seed: int | None = None) -> DataFrame:
    """``n`` uniform numbers from ``low`` up to ``high``: ``value``."""
    return spark.range(n).select((F.lit(float(low)) + F.rand(seed) * (float(high) - float(low))).alias("value"))


def random_rows(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """``n`` rows chosen at random, or all if there are fewer."""
    return df.orderBy(F.rand(seed)).limit(n)


def filter_estimate(df: DataFrame, column: str, op: str, value: object, distinct: str = "approximate") -> DataFrame:
    """``n_rows, selectivity, estimate`` of a comparison, from bounds and distinct values alone.

    Equality is one over the distinct values, its negation the rest, and a range the
    part of the way from the lowest to the highest value; outside of these 0 or 1.
    Nulls pass no comparison. An empty column has selectivity 0.
    """
    x, v = F.col(f"`{column}`"), F.lit(value)
    d = F.approx_count_distinct(x) if distinct == "approximate" else F.countDistinct(x)
    s = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(x).alias("full"), d.alias("d"), F.min(x).cast("double").alias("a"), F.max(x).cast("double").alias("b"))
    inside = (v >= F.col("a")) & (v <= F.col("b"))
    below = F.when(v <= F.col("a"), 0.0).when(v >= F.col("b"), 1.0).otherwise((v.cast("double") - F.col("a")) / (F.col("b") - F.col("a")))
    equal = F.when(inside, 1 / F.col("d")).otherwise(0.0)
    parts = {"=": equal, "<>": 1 - equal, "!=": 1 - equal, "<": below, "<=": below, ">": 1 - below, ">=": 1 - below}
    if op not in parts:
        raise ValueError(f"unknown operator {op}")
    part = F.when(F.col("full") > 0, parts[op] * F.col("full") / F.col("n_rows")).otherwise(0.0)
    return s.select("n_rows", part.alias("selectivity"), (part * F.col("n_rows")).alias("estimate"))


def column_stats(df: DataFrame, columns: Sequence[str], distinct: str = "exact") -> DataFrame:
    """``column_name, n_rows, n_null, n_distinct, min_value, max_value, avg_length``, values as text.

    All columns are measured in one pass. ``distinct="approximate"`` uses bounded
    memory per column. An empty table gives zeros and nulls.
    """
    count = F.approx_count_distinct if distinct == "approximate" else F.countDistinct
    parts = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        parts += [F.count(x).alias(f"n{i}"), count(x).alias(f"d{i}"), F.min(x).cast("string").alias(f"a{i}"), F.max(x).cast("string").alias(f"b{i}"), F.avg(F.length(x.cast("string"))).alias(f"l{i}")]
    wide = df.agg(F.count(F.lit(1)).alias("n"), *parts)
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"n{i}")).alias("n_null"), F.col(f"d{i}").alias("n_distinct"), F.col(f"a{i}").alias("min_value"), F.col(f"b{i}").alias("max_value"), F.col(f"l{i}").alias("avg_length"))
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*rows)))


def most_common(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent non-null values: ``value, n``; ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col("value").asc()).limit(k)


def frequency_histogram(df: DataFrame, column: str, k: int, other: str = "OTHER") -> DataFrame:
    """``bucket, n``: the ``k`` most frequent values as text, and one bucket for all the rest if there are any."""
    top = most_common(df, column, k).select(F.col("value").cast("string").alias("bucket"), "n")
    total = df.where(F.col(column).isNotNull()).agg(F.count(F.lit(1)).alias("n_all"))
    rest = total.join(top.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_top")), F.lit(True))  # one row each
    rest = rest.select(F.lit(other).alias("bucket"), (F.col("n_all") - F.col("n_top")).alias("n")).where("n > 0")
    return top.unionByName(rest)


def equi_height_histogram(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """``bucket, low, high, n, n_distinct``: slices of equal size in the order of the values, larger ones first.

    Values are merged with counts and ranked by a running sum of counts over
    value ranges, so no task sorts the whole column. Equal values may fall into
    two buckets. Nulls are left out; an empty column gives no rows.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed, total = _running_counts(counts)
    n, k = F.lit(total), F.lit(buckets)
    big, rest = F.floor(n / k), n % k
    edge = lambda r: F.when(r < rest * (big + 1), F.floor(r / (big + 1))).otherwise(rest + F.floor((r - rest * (big + 1)) / F.greatest(big, F.lit(1))))
    first, last = F.col("upto") - F.col("n"), F.col("upto") - 1
    parts = placed.withColumn("b", F.explode(F.sequence(edge(first).cast("long"), edge(last).cast("long"))))
    begin = F.when(F.col("b") < rest, F.col("b") * (big + 1)).otherwise(rest * (big + 1) + (F.col("b") - rest) * big)
    size = F.when(F.col("b") < rest, big + 1).otherwise(big)
    here = F.least(F.col("upto"), begin + size) - F.greatest(first, begin)
    return (
        parts.withColumn("here", here)
        .groupBy((F.col("b") + 1).cast("int").alias("bucket"))
        .agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("here").cast("long").alias("n"), F.count(F.lit(1)).alias("n_distinct"))
    )


def _running_counts(counts: DataFrame) -> tuple[DataFrame, int]:
    """``v, n, upto`` with the running count over all values, by prefix sums over sorted partitions; and the total."""
    from strataweave.sources.storage import materialize

    ordered = materialize(counts.repartitionByRange("v").withColumn("pid", F.spark_partition_id()), "sorted")
    sizes = ordered.groupBy("pid").agg(F.sum("n").alias("here"))
    offsets = sizes.withColumn("offset", F.sum("here").over(Window.partitionBy(F.lit(0)).orderBy("pid")) - F.col("here"))  # one row a partition
    total = sizes.agg(F.coalesce(F.sum("here"), F.lit(0))).first()[0]
    w = Window.partitionBy("pid").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return ordered.join(offsets, "pid").withColumn("upto", F.col("offset") + F.sum("n").over(w)).select("v", "n", "upto"), int(total)


def equi_width_histogram(df: DataFrame, column: str, low: float, high: float, buckets: int) -> DataFrame:
    """``bucket, n`` for ``buckets`` equal steps from ``low`` to ``high``; 0 and ``buckets + 1`` take values outside."""
    at = F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(buckets))
    return df.where(F.col(column).isNotNull()).groupBy(at.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def correlations(df: DataFrame, columns: Sequence[str], least: float = 0.0) -> DataFrame:
    """``a, b, r``: Pearson correlation of each pair of columns, all in one pass; pairs with ``|r|`` below ``least`` are left out."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return wide.select(F.inline(F.array(*rows))).where(F.abs("r") >= least)


def join_cardinality(left: DataFrame, right: DataFrame, on: tuple[str, str], distinct: str = "approximate") -> DataFrame:
    """``n_left, n_right, d_left, d_right, estimate``: rows times rows over the larger number of distinct keys."""
    d = F.approx_count_distinct if distinct == "approximate" else F.countDistinct
    a = left.agg(F.count(on[0]).alias("n_left"), d(on[0]).alias("d_left"))
    b = right.agg(F.count(on[1]).alias("n_right"), d(on[1]).alias("d_right"))
    n = F.col("n_left") * F.col("n_right") / F.greatest("d_left", "d_right", F.lit(1))
    return a.join(b, F.lit(True)).withColumn("estimate", n)
