"""Event-time windows, deduplication, messages, state with a lifetime, and triggers on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from strataweave.functions.text import glob_to_regex


def read_files(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, time: str, length: str, by: list[str], aggregates: list[Column], late: str, slide: str | None = None) -> DataFrame:
    """Tumbling, or with ``slide`` sliding, windows; rows later than ``late`` behind the newest are dropped."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return events.withWatermark(time, late).groupBy(w.alias("window"), *by).agg(*aggregates)


def sessions(events: DataFrame, time: str, gap: str, by: list[str], aggregates: list[Column], late: str) -> DataFrame:
    """Session windows that close after a gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("window"), *by).agg(*aggregates)


def deduplicated(events: DataFrame, time: str, keys: list[str], within: str) -> DataFrame:
    """The first row of each key within a span of event time; state is dropped after it."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def subscribe(messages: DataFrame, channel: str, names: list[str] | None = None, patterns: list[str] | None = None) -> DataFrame:
    """Messages of channels given by name or by shell pattern."""
    wanted = F.lit(False)
    for n in names or []:
        wanted = wanted | (F.col(channel) == n)
    for p in patterns or []:
        wanted = wanted | F.col(channel).rlike(glob_to_regex(p))
    return messages.where(wanted)


def publish(messages: DataFrame, path: str, checkpoint: str, channel: str) -> StreamingQuery:
    """Messages appended to files by channel, for other streams to read."""
    return messages.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(channel).trigger(availableNow=True).start()


def expiring_keys(writes: DataFrame, key: str, time: str, seconds: int, late: str) -> DataFrame:
    """``key, expired_at``: one row when a key has not been written for ``seconds`` of event time.

    State is one timestamp a key. A timer fires when the watermark passes it.
    """
    k_type = writes.schema[key].dataType
    out = T.StructType([T.StructField("key", k_type), T.StructField("expired_at", T.TimestampType())])
    state = T.StructType([T.StructField("last_us", T.LongType())])

    def step(k: tuple, parts: Iterator[pd.DataFrame], held: Any) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            (last,) = held.get
            held.remove()
            yield pd.DataFrame({"key": [k[0]], "expired_at": [pd.Timestamp(last, unit="us") + pd.Timedelta(seconds=seconds)]})
            return
        last = held.get[0] if held.exists else None
        for p in parts:
            newest = int(p["at"].max().value // 1000)
            last = newest if last is None else max(last, newest)
        held.update((last,))
        due = last // 1000 + seconds * 1000
        held.setTimeoutTimestamp(max(due, held.getCurrentWatermarkMs() + 1))

    rows = writes.select(F.col(key).alias("k"), F.col(time).cast("timestamp").alias("at")).withWatermark("at", late)
    return rows.groupBy("k").applyInPandasWithState(step, out, state, "append", "EventTimeTimeout")


def on_each_batch(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``action(rows, batch number)`` for every batch: triggers, upserts, several sinks. Batches can repeat after a failure; use the number to skip."""
    return stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_latest(stream: DataFrame, path: str, key: str, order: list[str], checkpoint: str) -> StreamingQuery:
    """The newest row of every key so far, in numbered folders under ``path``; each batch reads the last and writes the next."""
    from strataweave.operators.keyvalue import latest_per_key

    def merge(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        if number:
            rows = spark.read.schema(rows.schema).parquet(f"{path}/{number - 1}").unionByName(rows)
        latest_per_key(rows, key, order).write.mode("overwrite").parquet(f"{path}/{number}")

    return on_each_batch(stream, merge, checkpoint)


def latest_state(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What :func:`keep_latest` has last written under ``path``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return spark.read.schema(schema).parquet(f"{path}/{max(int(f.getPath().getName()) for f in found)}")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its result as a table in the shared folder.

    ``complete`` keeps the last state of the aggregation, ``append`` all rows that were put out.
    """
    import uuid

    from strataweave.sources.storage import shared_dir

    path = f"{shared_dir(stream.sparkSession)}/strataweave-stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(rows: DataFrame, number: int) -> None:
        part = "all" if mode == "complete" else f"part={number}"
        rows.write.mode("overwrite").parquet(f"{path}/data/{part}")

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{path}/data{'/all' if mode == 'complete' else ''}").select(*schema.fieldNames())


def to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into a table in memory, for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
