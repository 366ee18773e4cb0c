"""Kept hour states: which units failed which check in which hour, merged by reports that look back over many hours.

A shift summary counts distinct failing units of 8 hours. A unit that fails in two hours counts once, so hourly counts can't be
added, but hourly *sets* can be united: ``HourStates`` keeps the distinct (check, station, label, serial) rows of each hour
under ``hour=<hour>``. They are far fewer than the measurements, and a summary reads them in place of 8 hours of records.

* An hour's state holds the rows after its start and up to its end, as the reports' bounds are strict. The state of the hour
  of the run is open: like the reports, it holds all rows after its start, and the next run makes it again.
* A check is known by its definition. If a plan changes, hours without the changed check are made again.
* Every state says how many source rows its hour had. ``refresh`` counts them anew (one narrow column) and makes the hours
  again whose number has changed, so rows that come late are in the next summary.
* Each hour is replaced as a whole in one commit; running it again changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import fields
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linewatch.functions.time import ts_literal, window_start
from linewatch.operators.counts import tagged_counts
from linewatch.operators.limits import inline_rules
from linewatch.plans.checks import JobCheck, LinePlan, LineTables
from linewatch.sources.files import path_exists

_TIME = {"records": "recorded_at", "jobs": "started_at"}
#: Files of one hour: its rows are dealt by serial.
_FILES = 8


def check_key(check) -> str:
    """A name for a check that depends on its definition alone."""
    parts = []
    for f in fields(check):
        value = getattr(check, f.name)
        if f.name == "rules":
            value = sorted(map(repr, inline_rules(value, location_col=check.location_col)))
        parts.append(f"{f.name}={value!r}")
    return hashlib.sha256(f"{type(check).__name__}({', '.join(parts)})".encode()).hexdigest()[:16]


def mergeable(check) -> bool:
    """Whether a check counts distinct units of the report's window by a row test (A1-A6)."""
    return getattr(check, "since", None) is None and (isinstance(check, JobCheck) or (hasattr(check, "fusable") and check.fusable()))


def _hour(df: DataFrame, col: str) -> Column:
    """The label of the hour after whose start a row lies: a full hour itself belongs to the hour before."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", epoch, F.col(col).cast("timestamp_ntz"))
    start = F.timestamp_add("HOUR", F.floor((micros - 1) / 3_600_000_000), epoch)
    return F.translate(F.left(start.cast("string"), F.lit(13)), " ", "T")


def hour_key(hour: datetime) -> str:
    return f"{hour:%Y-%m-%dT%H}"


def _between(df: DataFrame, col: str, first: datetime, end: datetime | None) -> Column:
    """Rows after ``first`` and up to ``end``, if any; a plain test that reaches the scan."""
    kind = df.schema[col].dataType
    after = F.col(col) > ts_literal(first, kind)
    return after if end is None else after & (F.col(col) <= ts_literal(end, kind))


class HourStates:
    """The kept table at ``path``, for one set of plans; serials are of ``serial_type``."""

    def __init__(self, path: str, serial_type: str = "string"):
        self.path = path.rstrip("/")
        self.schema = StructType.fromDDL(
            f"check string, marker boolean, source_rows long, station_name string, parameter_name string, product_serial {serial_type}, hour string"
        )

    def read(self, spark: SparkSession) -> DataFrame:
        if not path_exists(spark, self.path):
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(self.path)

    def _source_rows(self, tables: LineTables, name: str, first: datetime, end: datetime) -> dict[str, int]:
        """Rows per hour up to ``end``; reads the time column only."""
        df = tables.bounded(name, first)
        rows = df.where(_between(df, _TIME[name], first, end)).groupBy(_hour(df, _TIME[name]).alias("hour")).count()
        return {r["hour"]: r["count"] for r in rows.collect()}  # one row per hour

    def refresh(self, tables: LineTables, plans: Sequence[LinePlan], as_of: datetime, hours: int = 8) -> list[str]:
        """Brings the states of the last ``hours`` hours up to ``as_of`` (on the records' clock) up to date.

        Made again are the hours without a state of some check of ``plans``, those whose number of source rows has changed, and
        the current one. Returns their names.
        """
        spark = tables.records.sparkSession
        first, last = window_start(as_of, hours), window_start(as_of, 0)  # the last hour's state is open
        checks = {check_key(c): c for p in plans for c in (*p.counts, *p.exact) if mergeable(c)}
        of = {key: "jobs" if isinstance(c, JobCheck) else "records" for key, c in checks.items()}
        now = {name: self._source_rows(tables, name, first, last) for name in set(of.values())}
        markers = self.read(spark).where(F.col("hour").between(hour_key(first), hour_key(last)) & F.col("marker")).select("hour", "check", "source_rows")
        kept = {(r.hour, r.check): r.source_rows for r in markers.collect()}  # hours x checks
        wanted = [first + timedelta(hours=h) for h in range(hours + 1)]
        # an open state has no number, so it is made again; it is the last one of this run, too
        stale = [h for h in wanted if h == last or any(kept.get((hour_key(h), key)) != now[name].get(hour_key(h), 0) for key, name in of.items())]
        if checks:
            self._write(tables, checks, of, stale, now)
        return [hour_key(h) for h in stale]

    def _write(self, tables: LineTables, checks: dict, of: dict[str, str], hours: list[datetime], now: dict[str, dict[str, int]]) -> None:
        spark = tables.records.sparkSession
        names = [hour_key(h) for h in hours]
        parts = []
        for name in sorted(set(of.values())):
            df = tables.bounded(name, hours[0])
            hits, tests = [], []
            for key, c in checks.items():
                if of[key] == name:
                    test = c.predicate(df, None)
                    label = F.lit(None) if getattr(c, "per_station", False) else F.col(c.label_col if name == "jobs" else "parameter_name")
                    tests.append(test)
                    hits.append(F.when(test, F.struct(F.lit(key).alias("check"), label.cast("string").alias("label"))))
            hour = F.least(_hour(df, _TIME[name]), F.lit(names[-1]))
            rows = df.where(_between(df, _TIME[name], hours[0], None) & reduce(lambda a, b: a | b, tests)).select(
                "product_serial", "station_name", hour.alias("hour"), F.explode(F.array(*hits)).alias("_hit")
            )
            rows = rows.where(F.col("_hit").isNotNull() & F.col("hour").isin(names)).select(
                F.col("_hit.check").alias("check"), "station_name", F.col("_hit.label").alias("parameter_name"), "product_serial", "hour"
            )
            parts.append(rows.distinct().withColumn("marker", F.lit(False)))
        marks = [(key, True, None if h == names[-1] else now[of[key]].get(h, 0), None, None, None, h) for h in names for key in checks]
        parts.append(spark.createDataFrame(marks, self.schema))
        states = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*self.schema.fieldNames())
        dealt = states.repartition("hour", F.pmod(F.xxhash64("product_serial"), F.lit(_FILES)))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour").parquet(self.path)

    def counts(self, spark: SparkSession, tagged: Sequence[tuple[str, object, datetime]]) -> DataFrame:
        """Distinct units per tag, station and label of ``(tag, check, lower bound)``, from the states of the hours since the bounds.

        Bounds are full hours. Has the rows that ``tagged_counts`` gives on the source tables, when the states are up to date.
        """
        states = self.read(spark)
        own = ~F.col("marker")
        preds = [(tag, own & (F.col("check") == check_key(c)) & (F.col("hour") >= hour_key(bound)), False) for tag, c, bound in tagged]
        return tagged_counts(states, preds, own & (F.col("hour") >= hour_key(min(b for *_, b in tagged))))
