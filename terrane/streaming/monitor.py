"""Streaming: rates, stalls and deduplication over an event stream. Event time is cast to timestamp first (watermarks need it)."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read_events(spark: SparkSession, path: str, pattern: str = "events.parquet", files: int = 64) -> DataFrame:
    """Events as a stream; ``files`` bounds what one batch takes."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def rates(events: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Records per tumbling window and type; works on a stream and on a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "15 minutes", late: str = "15 minutes") -> DataFrame:
    """Sessions per user: a stall is the gap that closes one."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def dedup(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def breaker(calls: DataFrame, by: str, order: str, failed, limit: int = 3, at: str | None = None, pause: int = 600) -> DataFrame:
    """Offline circuit breaker: the run length of consecutive failures, and whether it opens at each call; an opening starts the count anew.

    With ``at`` (a timestamp) also ``paused_until``, the latest end of a pause up to each call. A key's calls are a history with an order, and
    are taken in that order by one task a key; keys are callers.
    """
    w = Window.partitionBy(by).orderBy(order)
    runs = calls.withColumn("_f", failed.cast("int")).withColumn("_g", F.sum(1 - F.col("_f")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.sum("_f").over(Window.partitionBy(by, "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    found = runs.withColumn("failures", length).withColumn("opens", (F.col("failures") > 0) & (F.col("failures") % limit == 0)).drop("_f", "_g")
    if at is None:
        return found
    until = F.when(F.col("opens"), F.col(at) + F.make_interval(secs=F.lit(pause)))
    return found.withColumn("paused_until", F.max(until).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def throttle(calls: DataFrame, by: str, order: str, arrival: str, per_second: float) -> DataFrame:
    """Offline limiter: ``start``, when each call may go, in seconds. Calls go in order, at least 1 / per_second apart, none before it arrives.

    With i calls before it, a call starts at i / rate plus the greatest of arrival minus place / rate so far, so a running maximum decides all starts.
    """
    w = Window.partitionBy(by).orderBy(order)
    place = (F.row_number().over(w) - 1) / F.lit(per_second)
    rows = calls.withColumn("_place", place)
    slack = F.max(F.col(arrival) - F.col("_place")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("start", F.col("_place") + slack).drop("_place")


def metric_lines(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Batch metric lines: records per interval, rate per minute and running total."""
    slots = events.groupBy(F.window(F.col("ts").cast("timestamp"), f"{seconds} seconds")["start"].alias("start")).agg(F.count("*").alias("n"))
    running = Window.partitionBy(F.to_date("start")).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return slots.select("start", "n", (F.col("n") * 60.0 / seconds).alias("rate_per_min"), F.sum("n").over(running).alias("total_today"))


def run_to_table(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drives a stream through what is there now and returns the result; for tests and small reports."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def ingest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what is there now to a folder of JSON lines; the checkpoint remembers what was taken, so another run takes the rest only."""
    query = stream.writeStream.outputMode("append").format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


#: Seconds before another start after a stall and after any other failure.
AFTER_STALL, AFTER_FAILURE = 30, 120


class Stalled(Exception):
    """Nothing has come in for too long."""


def supervise(start: Callable[[], StreamingQuery], most_hours: float = 168.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> int:
    """Starts a streaming query again after failures, until it ends well or the time is over; returns the number of starts."""
    began, starts = clock(), 0
    while clock() - began < most_hours * 3600:
        starts += 1
        try:
            start().awaitTermination()
            return starts
        except Stalled:
            sleep(AFTER_STALL)
        except StreamingQueryException:
            sleep(AFTER_FAILURE)
    return starts
