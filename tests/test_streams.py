"""Streams that stop and start again: deduplication, stall alarms and late rows, run by run."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from terrane.streaming import stateful

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def runs(spark, tmp_path, schema, parts, stream):
    """Rows that each run adds to the results; every run is a new query from the same checkpoint."""
    out, seen = [], 0
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/landed")
        landed = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(f"{tmp_path}/landed")
        made = stream(landed).withColumn("run", F.lit(i))
        stateful.run_available(made, f"{tmp_path}/results", f"{tmp_path}/checkpoint")
        found = spark.read.schema(made.schema).parquet(f"{tmp_path}/results").collect()
        out.append([r for r in found if r.run == i])
        seen += len(out[-1])
        assert seen == len(found)
    return out


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_copies_are_known_after_a_restart(spark, tmp_path):
    first, again = [("a", at(0)), ("a", at(1)), (None, at(2))], [("a", at(50)), ("b", at(51)), (None, at(52)), ("b", at(53))]
    found = runs(spark, tmp_path, "key string, ts timestamp", [first, again, again], lambda s: stateful.first_seen(s, ["key"], "ts", "2 days").select("key"))
    assert [sorted(str(r.key) for r in run) for run in found] == [["None", "a"], ["b"], []]
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    assert "RocksDB" not in provider


def test_a_run_that_fails_half_way_is_taken_up_again(spark, tmp_path):
    """The first run breaks off after the rows of its first file; the next one yields the rest, and nothing twice."""
    flag = tmp_path / "broken"
    flag.write_text("")
    for i, keys in enumerate(("ab", "bc", "cd")):
        spark.createDataFrame([(k, at(i)) for k in keys], "key string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/landed")

    def breaking(batches):
        for rows in batches:
            if flag.exists() and "d" in set(rows["key"]):
                raise RuntimeError("torn")
            yield rows

    def run():
        landed = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/landed")
        stateful.run_available(stateful.first_seen(landed.mapInPandas(breaking, landed.schema), ["key"], "ts", "2 days").select("key"), f"{tmp_path}/results", f"{tmp_path}/checkpoint")
        return sorted(r.key for r in spark.read.schema("key string").parquet(f"{tmp_path}/results").collect())

    with pytest.raises(StreamingQueryException):
        run()
    assert sorted(r.key for r in spark.read.schema("key string").parquet(f"{tmp_path}/results").collect()) == ["a", "b", "c"]
    flag.unlink()
    assert run() == ["a", "b", "c", "d"] and run() == ["a", "b", "c", "d"]


def test_alarms_need_no_next_row_and_wait_for_late_ones(spark, tmp_path):
    rows = lambda *said: [(u, at(m)) for u, m in said]
    parts = [
        rows(("x", 0), ("x", 10), ("y", 0), ("z", 30)),
        rows(("z", 46), ("y", 29)),  # y's row comes late, but in time: nothing is known to be silent until the watermark passes
        rows(("z", 100)),
    ]
    found = runs(spark, tmp_path, "user string, ts timestamp", parts, lambda s: stateful.stalls(s, "user", late="20 minutes"))
    alarms = [sorted((r.key, (r.last_us - int(START.timestamp() * 1e6)) // 60_000_000, (r.alarm_us - r.last_us) // 60_000_000) for r in run) for run in found]
    # Watermarks after the runs: 10, 26 and 80 minutes.
    assert alarms == [[], [("x", 10, 15), ("y", 0, 15)], [("y", 29, 15), ("z", 30, 15), ("z", 46, 15)]]


def test_stalls_end_sessions_natively(spark, tmp_path):
    """Times a whole gap apart still are one session, a microsecond more parts them; state is a row a session, and no row passes through Python."""
    end = at(15)
    parts = [[("x", at(0)), ("x", end), ("y", at(0)), ("y", end + timedelta(microseconds=1)), *[("z", at(m / 100)) for m in range(1000)]], [("w", at(200))]]
    plans = []

    def stream(landed):
        made = stateful.stalls(landed, "user")
        plans.append(made._jdf.queryExecution().analyzed().toString())
        return made

    found = runs(spark, tmp_path, "user string, ts timestamp", parts, stream)
    base = int(START.timestamp() * 1e6)
    assert sorted((r.key, r.last_us - base) for run in found for r in run) == [("x", 900_000_000), ("y", 0), ("y", 900_000_001), ("z", 599_400_000)]
    assert not any("Python" in p or "Pandas" in p or "PySpark" in p for p in plans)


def test_late_rows_are_counted_apart(spark, tmp_path):
    parts = [[("a", at(0), 1.0), ("a", at(30), 1.0)], [("a", at(29), 2.0), ("a", at(1), 8.0), ("a", at(60), 1.0)]]
    schema = "event_type string, ts timestamp, value double"
    found = runs(spark, tmp_path, schema, parts, lambda s: stateful.closed_rates(s, late="10 minutes"))
    closed = spark.createDataFrame([tuple(r)[:4] for run in found for r in run], "start_us long, event_type string, n long, total double")
    came = spark.read.schema(schema).parquet(f"{tmp_path}/landed")
    base = int(START.timestamp() * 1e6)
    rows = stateful.with_late(closed, came, 60, base + 50 * 60_000_000).collect()
    assert sorted(((r.start_us - base) // 60_000_000, r.n, r.total, r.late) for r in rows) == [(0, 1, 1.0, 0), (1, 0, 0.0, 1), (29, 1, 2.0, 0), (30, 1, 1.0, 0)]
