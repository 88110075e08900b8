"""Mixing sources to target weights along a low-discrepancy schedule.

The documents of a source are put in a shuffled order and laid end to end, once
per repeat; what starts within the wanted size is chosen. The resulting stream of
each source is cut into blocks of equal size. Slots of the mix are given to
sources by mapping the points ``frac(i * golden ratio)`` through the cumulative
weights, and the r-th slot of a source takes its r-th block. Positions are prefix
sums over bounded buckets, so no task ever holds a whole source.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.llm.packing import byte_size
from strataweave.sources.storage import materialize

BLOCK_TOKENS = 65_536
BUCKET_DOCS = 50_000
CHUNK_SLOTS = 65_536
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)  # 2**64 divided by the golden ratio


class Mix(NamedTuple):
    chosen: DataFrame
    shares: DataFrame


def source_key(c: str | Column) -> Column:
    """Sources are compared in lower case without outer blanks."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def mix(docs: DataFrame, targets: DataFrame, seed: int = 0, block_tokens: int = BLOCK_TOKENS) -> Mix:
    """Choose documents so that each source has its target share of the total size of ``docs``.

    ``docs``: ``doc_id, source, text``; ``targets``: ``source, target_share,
    max_repeats`` (a short table; it is collected). ``chosen``: ``doc_id, source,
    repeat_no (from 0), slot, tokens``, to be read in the order of ``slot``, then
    ``doc_id``. ``shares``: ``source, target_share, available_tokens,
    wanted_tokens, used_tokens, reached_share, is_short``; the reached share is null where nothing is chosen at all; short are sources whose
    documents do not reach the wanted size with all repeats.

    Documents of a source without a target, and of a null source, are not chosen
    but count in the total. Empty and null texts have size 0 and are never chosen.
    Repeated rows are documents of their own. Targets with a null source, share or
    number of repeats are left out; repeated targets count once. Other columns are
    not read. Empty inputs give no chosen rows; targets without documents are short.
    """
    spark = docs.sparkSession
    sizes = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key("source").alias("key"), byte_size("text").alias("tokens")), "sizes")
    goals = targets.select("source", source_key("source").alias("key"), "target_share", F.col("max_repeats").cast("long").alias("max_repeats")).dropna().distinct()
    whole = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1))).first()
    total, n_docs = int(whole[0]), int(whole[1])
    buckets = max(1, -(-n_docs // BUCKET_DOCS))

    full = sizes.where("tokens > 0 and key is not null").withColumn("mixed", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod(F.col("mixed"), F.lit(buckets)))
    per_bucket = full.groupBy("key", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    offsets = per_bucket.withColumn("offset", F.sum("in_bucket").over(Window.partitionBy("key").orderBy("bucket")) - F.col("in_bucket"))
    by_key = per_bucket.groupBy("key").agg(F.sum("in_bucket").alias("available"))
    plan = (
        goals.join(by_key, "key", "left")
        .withColumn("available", F.coalesce("available", F.lit(0)))
        .withColumn("wanted", F.col("target_share") * F.lit(total))
        .withColumn("taken", F.least(F.col("wanted"), (F.col("available") * F.greatest(F.col("max_repeats"), F.lit(0))).cast("double")))
    )
    goal_rows = plan.orderBy("source").collect()  # one row a target
    if not goal_rows:
        empty = spark.createDataFrame([], "doc_id long, source string, repeat_no int, slot long, tokens long")
        return Mix(empty, spark.createDataFrame([], _SHARES))
    plan = spark.createDataFrame(goal_rows, plan.schema)

    in_order = Window.partitionBy("key", "bucket").orderBy("mixed", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        full.join(offsets.select("key", "bucket", "offset"), ["key", "bucket"])
        .withColumn("start", F.col("offset") + F.sum("tokens").over(in_order) - F.col("tokens"))
        .join(F.broadcast(plan.select("key", "source", "available", "taken")), "key")
    )
    rounds = F.floor(F.col("taken") / F.col("available"))
    repeats = rounds + F.when(F.col("start") < F.col("taken") - rounds * F.col("available"), 1).otherwise(0)
    copies = (
        placed.withColumn("repeats", repeats.cast("int"))
        .where("repeats > 0")
        .withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
        .withColumn("block", F.floor((F.col("start") + F.col("repeat_no") * F.col("available")) / block_tokens).cast("long"))
        .select("doc_id", "source", "repeat_no", "tokens", "block")
    )
    slots = schedule(spark, [(r["source"], r["taken"]) for r in goal_rows], block_tokens)
    n_slots = slots_needed([r["taken"] for r in goal_rows], block_tokens)
    # The schedule keeps each source within a few slots of its weight; blocks beyond its last slot follow at the end.
    chosen = copies.join(slots, ["source", "block"], "left").select(
        "doc_id", "source", "repeat_no", F.coalesce("slot", F.lit(n_slots) + F.col("block")).alias("slot"), "tokens"
    )
    return Mix(chosen, _shares(chosen, plan))


_SHARES = "source string, target_share double, available_tokens long, wanted_tokens double, used_tokens long, reached_share double, is_short boolean"


def _shares(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    used = chosen.groupBy("source").agg(F.sum("tokens").alias("used_tokens"))
    reached = F.try_divide("used_tokens", F.sum("used_tokens").over(Window.partitionBy(F.lit(0))))  # one row a target
    return (
        plan.join(used, "source", "left")
        .withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
        .select(
            "source",
            "target_share",
            F.col("available").alias("available_tokens"),
            F.col("wanted").alias("wanted_tokens"),
            "used_tokens",
            reached.alias("reached_share"),
            (F.col("used_tokens") < F.col("wanted")).alias("is_short"),
        )
    )


def slots_needed(weights: list[float], block_tokens: int) -> int:
    return sum(-(-int(w) // block_tokens) for w in weights)


def schedule(spark, weights: list[tuple[str, float]], block_tokens: int) -> DataFrame:
    """``source, block, slot``: the source of each slot and which of its blocks comes there."""
    n = slots_needed([w for _, w in weights], block_tokens)
    names = [s for s, _ in weights]
    upto = np.cumsum([w for _, w in weights]) / max(sum(w for _, w in weights), 1e-300)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b["id"].to_numpy()
            with np.errstate(over="ignore"):
                point = (i.astype(np.uint64) * _GOLDEN).astype(np.float64) / 2.0**64
            at = np.minimum(np.searchsorted(upto, point, "right"), len(names) - 1)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(names, pa.string()).take(pa.array(at))], ["slot", "source"])

    slots = spark.range(n).mapInArrow(assign, "slot long, source string").withColumn("chunk", F.floor(F.col("slot") / CHUNK_SLOTS))
    per_chunk = slots.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("in_chunk"))
    offsets = per_chunk.withColumn("offset", F.sum("in_chunk").over(Window.partitionBy("source").orderBy("chunk")) - F.col("in_chunk"))
    place = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot"))
    return (
        slots.join(offsets.select("source", "chunk", "offset"), ["source", "chunk"])
        .withColumn("block", (F.col("offset") + place - 1).cast("long"))
        .select("source", "block", "slot")
    )
