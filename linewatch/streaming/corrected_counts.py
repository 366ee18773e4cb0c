"""Failure counts as data arrives that late rows correct: a stateless stream into kept tables, window by window.

``fail_counts_stream`` emits a window once and drops what comes after its watermark. Here every micro-batch adds its units to
the sets of their windows and replaces the counts of the days it touched, however old, so the counts always equal a
batch count of all rows that have come. Under one folder, by the day on which a window starts:

* ``units/day=<day>/batch=<id>``: distinct (window, keys, serial) rows that a batch brought;
* ``counts/day=<day>``: the counts of a day's windows, replaced as a whole;
* ``late/batch=<id>``: rows that came after their window had closed, for the record;
* ``progress/batch=<id>``: the newest event time of the batch.

A batch that Spark runs again after a failure writes the same partitions again, so each row counts once. What a batch reads is
the sets of its days; the stream itself keeps no state and needs no watermark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from linewatch.operators.counts import COUNT
from linewatch.session import checkpoint_root
from linewatch.sources.files import path_exists
from linewatch.streaming.fail_counts import windowed

#: Files of a batch and day: its units are dealt by serial.
_FILES = 4


class CorrectedCounts:
    """Counts of distinct failing serials per window and keys in the folder ``path``.

    A window is closed, for ``late`` rows, when the newest event time of earlier batches is ``delay`` past its end.
    """

    def __init__(
        self, path: str, window: str = "1 hour", delay: str = "10 minutes", failing: Column | None = None,
        keys: Sequence[str] = ("station_name", "parameter_name"), serial_col: str = "product_serial", ts_col: str = "recorded_at",
    ):
        self.path, self.window, self.delay = path.rstrip("/"), window, delay
        self.failing, self.keys, self.serial_col, self.ts_col = failing, list(keys), serial_col, ts_col

    def _write(self, df: DataFrame, name: str, *by: str) -> None:
        """Replaces the partitions that the rows fall into."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.path}/{name}")

    def _read(self, like: DataFrame, name: str) -> DataFrame:
        """The table ``name`` with the columns of ``like``; partition values stay text."""
        spark = like.sparkSession
        if not path_exists(spark, f"{self.path}/{name}"):
            return spark.createDataFrame([], like.schema)
        return spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Takes in one micro-batch; the same rows under the same id may come again."""
        spark = batch.sparkSession
        failing = batch if self.failing is None else batch.where(self.failing)
        rows = windowed(failing.where(F.col(self.ts_col).isNotNull()), self.window, self.ts_col)
        day = F.left(F.col("window_start").cast("string"), F.lit(10)).alias("day")
        number = F.format_string("%020d", F.lit(batch_id)).alias("batch")
        rows = rows.select("window_start", "window_end", *self.keys, self.serial_col, self.ts_col, day, number).persist()
        try:
            newest = rows.agg(F.max(self.ts_col).alias("newest"), number)
            before = self._read(newest, "progress").where(F.col("batch") < number).agg(F.max("newest").alias("before"))
            closed = F.col("window_end") <= F.col("before") - F.expr(f"INTERVAL {self.delay}")
            # one row of ``before``; a batch without late rows clears what a failed attempt may have left
            late = rows.crossJoin(F.broadcast(before)).where(closed).drop("before")
            self._write(late, "late", "batch")
            units = rows.select("window_start", "window_end", *self.keys, self.serial_col, "day", "batch").distinct()
            self._write(units.repartition("day", F.pmod(F.xxhash64(self.serial_col), F.lit(_FILES))), "units", "day", "batch")
            touched = rows.select("day").distinct()  # as many as days in the batch's time span
            sets = self._read(units, "units").join(F.broadcast(touched), "day", "left_semi")
            counts = sets.groupBy("window_start", "window_end", *self.keys, "day").agg(F.countDistinct(self.serial_col).alias(COUNT))
            self._write(counts.select("window_start", "window_end", *self.keys, COUNT, "day").repartition("day"), "counts", "day")
            self._write(newest.where("newest IS NOT NULL"), "progress", "batch")
        finally:
            rows.unpersist()

    def start(self, records: DataFrame, name: str, available_now: bool = True) -> StreamingQuery:
        """Start the stream ``records`` into the tables. Its place in the input lies in ``streams/<name>`` in the shared checkpoint folder."""
        writer = records.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{checkpoint_root(records.sparkSession)}/streams/{name}")
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
        return writer.start()

    def run_available(self, records: DataFrame, name: str) -> None:
        """Take in everything that has come; later calls with the same name go on from there."""
        query = self.start(records, name)
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()

    def _kept(self, spark: SparkSession, name: str, schema: StructType, drop: str) -> DataFrame:
        if not path_exists(spark, f"{self.path}/{name}"):
            return spark.createDataFrame([], schema).drop(drop)
        return spark.read.schema(schema).parquet(f"{self.path}/{name}").drop(drop)

    def _schema(self, records: DataFrame, more: str) -> StructType:
        kind = records.schema[self.ts_col].dataType.simpleString()
        fields = [f"window_start {kind}", f"window_end {kind}", *(f"`{k}` {records.schema[k].dataType.simpleString()}" for k in self.keys)]
        return StructType.fromDDL(", ".join([*fields, more]))

    def counts(self, records: DataFrame) -> DataFrame:
        """window_start, window_end, the keys and the count, of all windows so far. ``records``: the stream, or a table like it."""
        return self._kept(records.sparkSession, "counts", self._schema(records, f"{COUNT} long, day string"), "day")

    def late(self, records: DataFrame) -> DataFrame:
        """The rows that came after their window had closed; they are in the counts."""
        serial, ts = (f"`{c}` {records.schema[c].dataType.simpleString()}" for c in (self.serial_col, self.ts_col))
        return self._kept(records.sparkSession, "late", self._schema(records, f"{serial}, {ts}, day string, batch string"), "day")
