"""Streaming failure counts: closed windows equal the batch count; late rows are dropped."""

import os
import tempfile
import time
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq

from linewatch.streaming import fail_counts_stream, run_available

SCHEMA = "product_serial string, station_name string, parameter_name string, recorded_at timestamp_ntz"


def _write(folder, name, rows):
    table = pa.table(
        {
            "product_serial": [r[0] for r in rows],
            "station_name": [r[1] for r in rows],
            "parameter_name": [r[2] for r in rows],
            "recorded_at": pa.array([r[3] for r in rows], pa.timestamp("us")),
        }
    )
    pq.write_table(table, os.path.join(folder, name))


def test_late_rows_dropped_and_closed_windows_emitted(spark):
    """Spark's chained stateful operators drop a row older than the watermark of the previous batch.

    Batch 0 moves the watermark to 15:20; batch 1 closes window 13-14 (count 2); the row at
    13:50 arrives in batch 2 and is dropped, so the emitted count stays 2.
    """
    folder = tempfile.mkdtemp(prefix="linewatch-stream-")
    _write(folder, "a.parquet", [
        ("u1", "S", "p", datetime(2024, 1, 15, 13, 10)),
        ("u2", "S", "p", datetime(2024, 1, 15, 13, 20)),
        ("u1", "S", "p", datetime(2024, 1, 15, 13, 40)),  # same unit again: counted once
        ("u3", "S", "p", datetime(2024, 1, 15, 15, 30)),  # moves the watermark to 15:20
    ])
    time.sleep(1.1)  # the file source orders files by modification time
    _write(folder, "b.parquet", [("u5", "S", "p", datetime(2024, 1, 15, 15, 25))])  # on time, window still open
    time.sleep(1.1)
    _write(folder, "c.parquet", [("u4", "S", "p", datetime(2024, 1, 15, 13, 50))])  # late: dropped
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    out = run_available(spark, fail_counts_stream(events, "1 hour", "10 minutes"))
    got = [(r.window_start, r.window_end, r.station_name, r.parameter_name, r.fail_count) for r in out.collect()]
    assert got == [(datetime(2024, 1, 15, 13, 0), datetime(2024, 1, 15, 14, 0), "S", "p", 2)]


def test_stream_to_parquet_sink(spark):
    from linewatch.streaming import start_stream

    folder = tempfile.mkdtemp(prefix="linewatch-stream-")
    _write(folder, "a.parquet", [
        ("u1", "S", "p", datetime(2024, 1, 15, 13, 10)),
        ("u2", "S", "p", datetime(2024, 1, 15, 13, 20)),
        ("u3", "S", "p", datetime(2024, 1, 15, 15, 30)),
    ])
    out = tempfile.mkdtemp(prefix="linewatch-sink-") + "/counts"
    events = spark.readStream.schema(SCHEMA).parquet(folder)
    query = start_stream(fail_counts_stream(events, "1 hour", "10 minutes"), name="sink_test", sink="parquet", path=out, checkpoint=tempfile.mkdtemp(prefix="linewatch-ckpt-"))
    query.awaitTermination()
    assert query.exception() is None
    got = [(r.window_start, r.fail_count) for r in spark.read.parquet(out).collect()]
    assert got == [(datetime(2024, 1, 15, 13, 0), 2)]


def test_stream_windows_follow_the_wall_clock_in_any_session_zone(spark):
    folder = tempfile.mkdtemp(prefix="linewatch-stream-")
    _write(folder, "a.parquet", [
        ("u1", "S", "p", datetime(2024, 1, 15, 13, 10)),
        ("u2", "S", "p", datetime(2024, 1, 15, 13, 50)),
        ("u3", "S", "p", datetime(2024, 1, 15, 15, 30)),
    ])
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")  # UTC+5:30
    try:
        events = spark.readStream.schema(SCHEMA).parquet(folder)
        out = run_available(spark, fail_counts_stream(events, "1 hour", "10 minutes"))
        got = [(r.window_start, r.window_end, r.fail_count) for r in out.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [(datetime(2024, 1, 15, 13, 0), datetime(2024, 1, 15, 14, 0), 2)]
