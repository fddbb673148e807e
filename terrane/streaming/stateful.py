"""Stateful streams that survive restarts: deduplication over runs, stall alarms by sessions, rates with late rows.

State lives in RocksDB, so it may outgrow memory, and is checkpointed with the offsets: a query that starts again from its checkpoint
knows all that the runs before it have seen. Rows are reduced in the tasks that read them before they are dealt by key, so a key that
holds a large share of all rows sends few of them to its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # A run that ends leaves no open stores, with files of their own for each state partition, on the executors.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    # Sessions are merged in the tasks that read their rows, before these are dealt by key.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; the session's own settings come back at the end."""
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """One run: takes what has come in since the checkpoint, appends the results to a folder of Parquet files exactly once, and stops."""
    with rocksdb(stream.sparkSession):
        stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_seen(stream: DataFrame, keys: list[str], at: str, horizon: str) -> DataFrame:
    """The first row of each key over all runs; repeats up to ``horizon`` later in event time ``at`` go. State is dropped beyond it.

    Copies that one task reads together are reduced before the shuffle.
    """

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.drop_duplicates(keys)

    return stream.mapInPandas(reduce, stream.schema).withWatermark(at, horizon).dropDuplicatesWithinWatermark(keys)


def stalls(stream: DataFrame, key: str, at: str = "ts", gap_seconds: int = 900, late: str = "15 minutes") -> DataFrame:
    """(key, last_us, alarm_us): a key's times after which nothing came for ``gap_seconds``, as soon as the watermark has passed the gap.

    Times no further apart than the gap are one session, whose end is the alarm; it needs no next row, and is told when no row of the gap can still come.
    State is one row a session that is still open, however many times it holds.
    """
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(at).alias("ts")).withWatermark("ts", late)
    last = F.unix_micros("last")
    sessions = rows.groupBy("key", F.session_window("ts", f"{gap_seconds} seconds")).agg(F.max("ts").alias("last"))
    return sessions.select("key", last.alias("last_us"), (last + gap_seconds * 1_000_000).alias("alarm_us"))


def closed_rates(stream: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start_us, event_type, n, total) of windows that the watermark has closed; rows that come later than ``late`` are dropped, and so is a window's state."""
    windows = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return windows.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n", "total")


def with_late(closed: DataFrame, came: DataFrame, width_seconds: int, until_us: int) -> DataFrame:
    """Closed windows with ``late``, the number of rows that had come in for them but were too late to count. ``came`` holds all that came in.

    Windows are those that end by ``until_us``, the last watermark; one that only late rows fall into has n 0.
    """
    width = width_seconds * 1_000_000
    start = (F.floor(F.unix_micros("ts") / width) * width).alias("start_us")
    every = came.groupBy(start, "event_type").agg(F.count("*").alias("came")).filter(F.col("start_us") + width <= until_us)
    joined = every.join(closed, ["start_us", "event_type"], "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select("start_us", "event_type", n.alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"), (F.col("came") - n).alias("late"))
