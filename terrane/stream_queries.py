"""Registered queries over streams: tables land in parts, a stream runs after each part and starts again from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .plans.testviews import table
from .queries import Query
from .sources.scratch import shared_folder
from .streaming import stateful

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _runs(parts: list[DataFrame], name: str, stream: Callable[[DataFrame, int], DataFrame]) -> tuple[str, str]:
    """Lands each part and runs the stream anew after it; (folder of what landed, folder of results)."""
    path = shared_folder(parts[0].sparkSession, name)
    for i, part in enumerate(parts):
        part.write.mode("append").parquet(f"{path}/landed")
        landed = part.sparkSession.readStream.schema(part.schema).parquet(f"{path}/landed")
        stateful.run_available(stream(landed, i), f"{path}/results", f"{path}/checkpoint")
    return f"{path}/landed", f"{path}/results"


def _results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


@query
def stream_restart_dedup(spark, d):
    """Texts by hash over four runs of one stream, the third of which repeats what the second brought."""
    rows = table(spark, d, "documents").select(text.content_hash(F.col("text")).alias("content_hash"), F.timestamp_millis(F.col("doc_id") + 1577836800000).alias("at"), (F.col("doc_id") % 3).alias("part"))
    parts = [rows.filter(f"part = {k}").drop("part") for k in (0, 1, 1, 2)]
    _, found = _runs(parts, "dedup", lambda s, i: stateful.first_seen(s, ["content_hash"], "at", "3650 days").select("content_hash", F.lit(i).alias("run")))
    return _results(spark, found, "content_hash string, run int")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events with the part they come in: thirds of the time by date; of the last ten minutes of a third every other one comes with the next."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    third = lambda ts: F.when(ts < F.timestamp_micros(F.lit(1704931200000000)), 0).when(ts < F.timestamp_micros(F.lit(1705795200000000)), 1).otherwise(2)
    soon = F.timestamp_micros(F.unix_micros("ts") + 600_000_000)
    return e.withColumns({"third": third(F.col("ts")), "part": F.when(F.col("event_id") % 2 == 0, third(soon)).otherwise(third(F.col("ts")))})


@query
def stream_stall_alarms(spark, d):
    """Alarms of users who were silent for 15 minutes, told by the watermark in three runs of one stream."""
    e = _events(spark, d).select("user_id", "ts", "part")
    _, found = _runs([e.filter(f"part = {k}").drop("part") for k in range(3)], "stalls", lambda s, i: stateful.stalls(s, "user_id"))
    return _results(spark, found, "key string, last_us long, alarm_us long")


@query
def stream_late_rates(spark, d):
    """Rates by minute in append mode; every fiftieth event comes one part late, most of them too late for their window."""
    e = _events(spark, d).select("event_id", "ts", "event_type", "value", F.least(F.lit(2), F.when(F.col("event_id") % 50 == 0, F.col("third") + 1).otherwise(F.col("part"))).alias("part"))
    landed, found = _runs([e.filter(f"part = {k}").drop("part") for k in range(3)], "rates", lambda s, i: stateful.closed_rates(s))
    came = spark.read.schema(e.drop("part").schema).parquet(landed)
    last = came.agg(F.max(F.unix_micros("ts"))).first()[0] or 0
    closed = _results(spark, found, "start_us long, event_type string, n long, total double")
    rows = stateful.with_late(closed, came, 60, last - 600_000_000)
    return rows.select("start_us", "event_type", "n", F.round("total", 4).alias("total"), "late")


_ARRIVED = """z AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS third,
  CASE WHEN ts + INTERVAL 10 MINUTE < TIMESTAMP '2024-01-11' THEN 0 WHEN ts + INTERVAL 10 MINUTE < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS soon FROM events),
e AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN soon ELSE third END AS part FROM z)"""
ORACLES: dict[str, str] = {
    "stream_restart_dedup": "SELECT sha256(coalesce(text, '')) AS content_hash, min(CASE doc_id % 3 WHEN 2 THEN 3 ELSE doc_id % 3 END)::INTEGER AS run FROM documents GROUP BY 1",
    "stream_stall_alarms": f"""WITH {_ARRIVED}, t AS (SELECT DISTINCT user_id, epoch_us(ts) AS us FROM e), n AS (SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY us) AS next FROM t)
SELECT user_id::VARCHAR AS key, us AS last_us, us + 900000000 AS alarm_us FROM n WHERE (next IS NULL OR next - us > 900000000) AND us + 900000000 <= (SELECT max(epoch_us(ts)) - 900000000 FROM events)""",
    "stream_late_rates": f"""WITH {_ARRIVED}, a AS (SELECT *, epoch_us(date_trunc('minute', ts)) AS start_us, least(2, CASE WHEN event_id % 50 = 0 THEN third + 1 ELSE part END) AS came FROM e),
w AS (SELECT (SELECT max(epoch_us(ts)) - 600000000 FROM a WHERE came = 0) AS w0, (SELECT max(epoch_us(ts)) - 600000000 FROM a WHERE came <= 1) AS w1, (SELECT max(epoch_us(ts)) - 600000000 FROM a) AS w2),
k AS (SELECT a.*, (came = 1 AND start_us + 60000000 <= w0) OR (came = 2 AND start_us + 60000000 <= w1) AS late FROM a, w WHERE start_us + 60000000 <= w2)
SELECT start_us, event_type, count(*) FILTER (NOT late) AS n, round(coalesce(sum(value) FILTER (NOT late), 0), 4) AS total, count(*) FILTER (late) AS late FROM k GROUP BY 1, 2""",
}
