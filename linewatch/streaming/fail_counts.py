"""Failure counts as data arrives: Structured Streaming with event-time windows.

``countDistinct`` is not allowed on a stream, so distinct failing units per
(window, station, parameter) are counted in two stateful steps: drop repeated
(window, keys, serial) rows, then count per (window, keys). Both states are
keyed by the event-time window, so the watermark evicts them once a window
closes. A window is emitted once the watermark (newest event time minus
``delay``) passes its end. A row older than the watermark of the previous
micro-batch is dropped (Spark's rule for chained stateful operators), so a
late row can still count while its window is open in the same batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import TimestampNTZType

from linewatch.operators.counts import COUNT
from linewatch.session import checkpoint_root


def _epoch():
    """The wall-clock epoch, for zone-free conversions between wall clocks and instants."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _event_time(df: DataFrame, ts_col: str) -> Column:
    """The instant of a time column. A wall clock (NTZ) becomes the instant with the same UTC reading, so windows fall on
    wall-clock hours whatever the session zone (half-hour zones, DST gaps)."""
    if isinstance(df.schema[ts_col].dataType, TimestampNTZType):
        return F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch(), F.col(ts_col)))
    return F.col(ts_col)


def _bound(df: DataFrame, ts_col: str, bound: str) -> Column:
    """A window's bound as the kind of time that ``ts_col`` of ``df`` is."""
    if isinstance(df.schema[ts_col].dataType, TimestampNTZType):
        return F.timestamp_add("MICROSECOND", F.unix_micros(F.col(bound)), _epoch())
    return F.col(bound)


def windowed(df: DataFrame, window: str, ts_col: str = "recorded_at") -> DataFrame:
    """``df`` with ``window_start`` and ``window_end`` of the tumbling window that each row lies in."""
    rows = df.withColumn("_window", F.window(_event_time(df, ts_col), window))
    return rows.withColumns({f"window_{end}": _bound(df, ts_col, f"_window.{end}") for end in ("start", "end")}).drop("_window")


def fail_counts_stream(
    records: DataFrame,
    window: str = "1 hour",
    delay: str = "10 minutes",
    failing: Column | None = None,
    keys: Sequence[str] = ("station_name", "parameter_name"),
    serial_col: str = "product_serial",
    ts_col: str = "recorded_at",
) -> DataFrame:
    """Distinct failing serials per tumbling event-time window and keys (append mode)."""
    df = records if failing is None else records.where(failing)
    df = df.withColumn("_event_time", _event_time(df, ts_col)).withWatermark("_event_time", delay)  # a watermark needs an instant
    units = df.select(F.window("_event_time", window).alias("window"), *keys, serial_col).dropDuplicates(["window", *keys, serial_col])
    counted = units.groupBy("window", *keys).agg(F.count(F.lit(1)).alias(COUNT))
    start, end = (_bound(df, ts_col, f"window.{end}").alias(f"window_{end}") for end in ("start", "end"))
    return counted.select(start, end, *keys, COUNT)


def start_stream(
    result: DataFrame, name: str, sink: str = "parquet", path: str | None = None, checkpoint: str | None = None, available_now: bool = True
) -> StreamingQuery:
    """Start ``result`` in append mode.

    The state lies in ``checkpoint``, by default ``streams/<name>`` in the shared
    checkpoint folder: the same folder on every start, so a run goes on where the
    last one stopped and a file sink gets each window once. Give a stream its own
    name, and a new one when its query changes.
    """
    location = checkpoint or f"{checkpoint_root(result.sparkSession)}/streams/{name}"
    writer = result.writeStream.outputMode("append").format(sink).option("checkpointLocation", location)
    if sink == "memory":
        writer = writer.queryName(name)
    elif path is not None:
        writer = writer.option("path", path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def run_available(spark: SparkSession, result: DataFrame, name: str | None = None, path: str | None = None) -> DataFrame:
    """Process everything available now into Parquet files and return the windows emitted so far.

    With a ``name``, later calls go on with the input that came since and add to
    the same files; without one the run stands alone. Files go to ``path``, by
    default ``streams-out/<name>`` in the shared checkpoint folder.
    """
    name = name or f"fail_counts_{uuid.uuid4().hex}"
    path = path or f"{checkpoint_root(spark)}/streams-out/{name}"
    query = start_stream(result, name, path=path)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(result.schema).parquet(path)
