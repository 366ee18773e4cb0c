"""The kept origin table: which station made a child part, maintained run by run beside the records.

A trace needs the origin-station records of a failing unit's children, however old. Reading them from the records means
reading the history of the line on every run. ``OriginStore`` keeps the few columns that a trace needs, one row per child,
station and parameter of a day, under ``period=<day>/station_name=<station>/serial_bucket=<bucket>``:

* ``update`` rewrites whole days. Running it again, or after late or corrected records, leaves what the records hold now.
* ``fold`` merges the days of past months into one period each, so that the number of files stays small.
* A trace over the store reads the stations of its test (a partition filter) and the buckets of the failing units' children
  (found at run time, see ``linewatch.operators.trace``).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import replace
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linewatch.functions.time import ts_literal
from linewatch.operators.trace import serial_bucket
from linewatch.sources.files import delete_path, path_exists

_PARTS = ("period", "station_name", "serial_bucket")


class OriginStore:
    """A maintained table of origin rows at ``path``.

    ``buckets`` (a power of two) is fixed for a store and part of its path. ``extra`` names further columns that the traces'
    origin tests read, as DDL (``"line_name string, shop_name string"``). Serials are of ``serial_type``.
    """

    def __init__(self, path: str, buckets: int = 64, extra: str = "", serial_type: str = "string"):
        serial_bucket(F.lit(""), buckets)  # checks the number
        self.root = f"{path.rstrip('/')}/buckets={buckets}"
        self.buckets = buckets
        fields = StructType.fromDDL(f"product_serial {serial_type}, parameter_name string" + (f", {extra}" if extra else ""))
        self.columns = fields.fieldNames()
        self.schema = StructType.fromDDL("period string, station_name string, serial_bucket int, run string")
        self.schema = StructType([*fields, *self.schema.fields])

    def _read(self, spark: SparkSession) -> DataFrame:
        if not path_exists(spark, self.root):
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(self.root)

    def rows(self, spark: SparkSession) -> DataFrame:
        """All origin rows: the serial, its station and parameter, the extra columns, and ``serial_bucket``."""
        return self._read(spark).select(*self.columns, "station_name", "serial_bucket")

    def tables(self, tables):
        """``LineTables`` whose traces read this store in place of the records."""
        return replace(tables, children=self.rows(tables.records.sparkSession), child_buckets=self.buckets)

    def _write(self, rows: DataFrame, run: str) -> None:
        """Replaces the partitions that ``rows`` fall into, in one commit."""
        bucket = serial_bucket(F.col("product_serial"), self.buckets)
        placed = rows.select(*self.columns, "period", "station_name").distinct().withColumns({"serial_bucket": bucket, "run": F.lit(run)})
        # one file per partition; a station's rows of a day are dealt over its buckets
        dealt = placed.repartition(*_PARTS).sortWithinPartitions(*_PARTS, "product_serial")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_PARTS).parquet(self.root)

    def _drop_other_runs(self, spark: SparkSession, periods: Column, run: str) -> None:
        """Deletes the files of ``periods`` that another run wrote: partitions that have no rows any more."""
        old = self._read(spark).where(periods & (F.col("run") != run)).select(F.col("_metadata.file_path")).distinct()
        for r in old.toLocalIterator():  # at most one file per station, bucket and day of the update
            delete_path(spark, r[0], encoded=True)

    def update(self, records: DataFrame, origin: Column, first: date, last: date | None = None, ts_col: str = "recorded_at") -> None:
        """Makes the days ``first`` to ``last`` (default: the one day) hold exactly the origin rows of ``records`` of these days.

        ``origin`` is the traces' row test. The days are those of the records' wall clock. Each day is replaced as a whole, so
        the result does not depend on what earlier runs saw; readers see the old or the new files of a partition.
        """
        last = last or first
        spark, run = records.sparkSession, uuid.uuid4().hex
        kind = records.schema[ts_col].dataType
        start, end = datetime.combine(first, time()), datetime.combine(last + timedelta(days=1), time())
        inside = (F.col(ts_col) >= ts_literal(start, kind)) & (F.col(ts_col) < ts_literal(end, kind))
        rows = records.where(origin & inside).select(*self.columns, "station_name", F.date_format(ts_col, "yyyy-MM-dd").alias("period"))
        self._write(rows, run)
        if path_exists(spark, self.root):
            self._drop_other_runs(spark, F.col("period").between(first.isoformat(), last.isoformat()) & (F.length("period") == 10), run)

    def fold(self, spark: SparkSession, before: date) -> None:
        """Merges the days of the months before the month of ``before`` into one period per month.

        Rows that stand there already stay. If it is interrupted, a day's rows are in the store twice until it runs again,
        which changes no trace: it counts distinct units.
        """
        if not path_exists(spark, self.root):
            return
        run = uuid.uuid4().hex
        past = F.left("period", F.lit(7)) < F.lit(f"{before:%Y-%m}")
        months = [r[0] for r in self._read(spark).where(past & (F.length("period") == 10)).select(F.left("period", F.lit(7))).distinct().collect()]
        if not months:
            return
        touched = F.left("period", F.lit(7)).isin(months)
        self._write(self._read(spark).where(touched).withColumn("period", F.left("period", F.lit(7))), run)
        self._drop_other_runs(spark, touched & (F.length("period") == 10), run)


def any_origin(tests: Sequence[Column]) -> Column:
    """The rows that some trace takes as origins."""
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out
