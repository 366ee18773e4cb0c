"""Report configuration: which counts a report holds, as data.

Each check is a small frozen dataclass that turns the line's tables and the
report's lower time bound into one result DataFrame with columns
``fail_count, station_name, parameter_name`` (alarm counts use
``alarm_description`` for the label, as the original report did).
Predicates given as text are Spark SQL expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewatch.functions.text import bracket_tag
from linewatch.functions.time import ts_literal, until_local
from linewatch.operators import alarms as al
from linewatch.operators import counts as ct
from linewatch.operators.limits import MAX_INLINE_RULES, inline_rules, out_of_spec
from linewatch.operators.trace import trace_origin
from linewatch.defaults import ALARM_PRIORITIES, DEBOUNCE_SECONDS, LINE_TZ, NOK_STATUS, OK_STATUS, ORIGINAL_ALARM_COLUMNS, ORIGIN_PARAMETER, SHIFT_END_HOURS, TAG_MARKER


@dataclass
class LineTables:
    """The line's tables. ``children``/``failures`` default to ``records``.

    ``date_partitions`` names a date partition column per table
    (``{"records": "recorded_date", ...}``). Every bounded read then also
    filters that column (one day of slack for time zones), which Spark turns
    into partition pruning: only the recent partitions are listed and read.

    ``column_names`` says how a table names the columns that the checks read
    (``{"alarms": {"alarm_source": "source_code"}}``, canonical to own name).
    Alarms that have the names of the original report are recognized without it.

    ``child_buckets``: ``children`` is partitioned by ``serial_bucket`` of so many buckets (see ``OriginStore``).
    ``trace_filter``: whether traces filter ``children`` at run time by the failing units' children (None: by its size).
    """

    records: DataFrame
    alarms: DataFrame
    jobs: DataFrame
    genealogy: DataFrame
    children: DataFrame | None = None
    failures: DataFrame | None = None
    date_partitions: dict = field(default_factory=dict)
    column_names: dict = field(default_factory=dict)
    child_buckets: int | None = None
    trace_filter: bool | None = None

    def __post_init__(self) -> None:
        own = {"alarms": {c: o for c, o in ORIGINAL_ALARM_COLUMNS.items() if c not in self.alarms.columns and o in self.alarms.columns}}
        for table in ("records", "alarms", "jobs", "genealogy", "children", "failures"):
            names = {**own.get(table, {}), **self.column_names.get(table, {})}
            if names and getattr(self, table) is not None:
                setattr(self, table, getattr(self, table).withColumnsRenamed({o: c for c, o in names.items()}))
        self.column_names = {}  # done; a changed copy must not rename again

    def child_rows(self) -> DataFrame:
        return self.children if self.children is not None else self.records

    def failure_rows(self) -> DataFrame:
        return self.failures if self.failures is not None else self.records

    def until(self, end_local: datetime, local_tz: str = LINE_TZ, alarm_tz: str = "UTC") -> "LineTables":
        """The same tables cut at ``end_local`` (inclusive, on the line's wall clock).

        The original counted everything after the bound, so an "hourly" report
        could hold up to two hours; this gives an exact window. Alarm times
        are converted from ``alarm_tz`` before the test.
        """
        def cut(df: DataFrame, col: str, source_tz: str | None = None) -> DataFrame:
            if source_tz is not None:
                return df.where(until_local(df, col, end_local, source_tz, local_tz))
            return df.where(F.col(col) <= ts_literal(end_local, df.schema[col].dataType))

        return replace(
            self,
            records=cut(self.records, "recorded_at"),
            alarms=cut(self.alarms, "activated_at", alarm_tz),
            jobs=cut(self.jobs, "started_at"),
            failures=None if self.failures is None else cut(self.failures, "recorded_at"),
        )

    def bounded(self, name: str, bound: datetime | None) -> DataFrame:
        """Table ``name`` pruned to the partitions that can hold rows after ``bound``."""
        df = {"records": self.records, "alarms": self.alarms, "jobs": self.jobs, "failures": self.failure_rows()}[name]
        source = "records" if name == "failures" and self.failures is None else name
        col = self.date_partitions.get(source)
        if col is None or bound is None:
            return df
        return df.where(F.col(col) >= F.lit((bound - timedelta(days=1)).date()))


def _where(expr: str | None):
    return None if expr is None else F.expr(expr)


def _inline(rules, location_col: str | None = None) -> list[tuple] | None:
    """Rule rows for a row test: a list of any length (it is on the driver already), a small rules table, else None."""
    return inline_rules(rules, max_rules=MAX_INLINE_RULES if isinstance(rules, DataFrame) else None, location_col=location_col)


@dataclass(frozen=True)
class JobCheck:
    """Units whose station job did not end OK, per work-location label."""

    station: str | None = None
    station_like: str | None = None
    ok_status: str = OK_STATUS
    label_col: str = "work_location_desc"
    where: str | None = None
    since: datetime | None = None

    def predicate(self, jobs: DataFrame, bound: datetime) -> Column:
        return ct.job_fail_filter(jobs, self.since or bound, self.station, self.station_like, self.ok_status, _where(self.where))

    def frame(self, t: LineTables, bound: datetime, local_tz: str) -> DataFrame:
        return ct.job_fail_counts(
            t.bounded("jobs", self.since or bound), self.since or bound, self.station, self.station_like, self.ok_status, self.label_col, _where(self.where)
        )


@dataclass(frozen=True)
class ParamCheck:
    """Units with a NOK status for one parameter (and parameter id)."""

    parameter: str
    station: str | None = None
    station_like: str | None = None
    parameter_id: int | None = None
    status: str = NOK_STATUS
    where: str | None = None
    since: datetime | None = None
    per_station = False

    def fusable(self) -> bool:
        return True

    def predicate(self, records: DataFrame, bound: datetime) -> Column:
        return ct.param_fail_filter(
            records, self.since or bound, self.parameter, self.station, self.station_like, self.parameter_id, self.status, _where(self.where)
        )

    def frame(self, t: LineTables, bound: datetime, local_tz: str) -> DataFrame:
        return ct.param_fail_counts(
            t.bounded("records", self.since or bound), self.since or bound, self.parameter, self.station, self.station_like, self.parameter_id, self.status, _where(self.where)
        )


@dataclass(frozen=True)
class NokCheck:
    """Units with a NOK status, per parameter."""

    station: str | None = None
    station_like: str | None = None
    status: str = NOK_STATUS
    where: str | None = None
    since: datetime | None = None
    per_station = False

    def fusable(self) -> bool:
        return True

    def predicate(self, records: DataFrame, bound: datetime) -> Column:
        return ct.nok_filter(records, self.since or bound, self.station, self.station_like, self.status, _where(self.where))

    def frame(self, t: LineTables, bound: datetime, local_tz: str) -> DataFrame:
        return ct.station_nok_counts(t.bounded("records", self.since or bound), self.since or bound, self.station, self.station_like, self.status, _where(self.where))


@dataclass(frozen=True)
class SpecCheck:
    """Units outside a limit set, per parameter; or per station with ``per_station``.

    ``rules`` are rule rows (see ``linewatch.operators.limits``).
    """

    rules: Sequence[tuple]
    station: str | None = None
    station_like: str | None = None
    value_col: str = "parameter_value_raw"
    location_col: str | None = None
    status: str | None = None
    per_station: bool = False
    where: str | None = None
    since: datetime | None = None

    def fusable(self) -> bool:
        return _inline(self.rules, self.location_col) is not None

    def predicate(self, records: DataFrame, bound: datetime) -> Column:
        rows = _inline(self.rules, self.location_col)
        return ct.spec_fail_filter(
            records, self.since or bound, rows, self.station, self.station_like, self.value_col, self.location_col,
            self.status, _where(self.where),
        )

    def frame(self, t: LineTables, bound: datetime, local_tz: str) -> DataFrame:
        fn = ct.station_unique_fails if self.per_station else (
            ct.out_of_spec_location_counts if self.location_col else ct.out_of_spec_counts
        )
        kwargs = dict(station=self.station, station_like=self.station_like, value_col=self.value_col, status=self.status, where=_where(self.where))
        if self.location_col or self.per_station:
            kwargs["location_col"] = self.location_col
        return fn(t.bounded("records", self.since or bound), self.rules, self.since or bound, **kwargs)


@dataclass(frozen=True)
class AlarmReportCheck:
    """Debounced count of one alarm kind plus per-tag counts of another kind."""

    station: str
    label: str
    debounce_match: str
    tag_match: str
    source_like: str | None = None
    priorities: tuple[str, ...] = ALARM_PRIORITIES
    gap_seconds: int = DEBOUNCE_SECONDS
    marker: str = TAG_MARKER
    source_tz: str = "UTC"

    def frame(self, t: LineTables, bound: datetime, local_tz: str) -> DataFrame:
        return al.alarm_report(
            t.bounded("alarms", bound), self.station, self.label, self.debounce_match, self.tag_match, bound, self.source_like,
            self.priorities, self.gap_seconds, self.marker, self.source_tz, local_tz,
        )

    def debounced(self, alarms: DataFrame, bound: datetime, local_tz: str) -> tuple[Column, int, str, str]:
        """The debounced count as ``(scope test, gap seconds, description pattern, label)`` for a fused alarm pass."""
        scope = al.alarm_scope_filter(alarms, bound, self.source_like, self.priorities, self.source_tz, local_tz)
        return scope, self.gap_seconds, self.debounce_match, self.label

    def alarm_parts(self, alarms: DataFrame, bound: datetime, local_tz: str) -> list[tuple[Column, Column, str, str]]:
        """The tag counts as ``(row test, label, station, label column)`` for a fused alarm pass."""
        scope = al.alarm_scope_filter(alarms, bound, self.source_like, self.priorities, self.source_tz, local_tz)
        test = scope & F.col(al.DESCRIPTION).ilike(self.tag_match)
        return [(test, bracket_tag(al.DESCRIPTION, self.marker), self.station, "parameter_name")]


@dataclass(frozen=True)
class AlarmCountCheck:
    """Count of matching alarms under a fixed label; no row when there are none."""

    station: str
    label: str
    match: str
    source_like: str | None = None
    priorities: tuple[str, ...] = ALARM_PRIORITIES
    source_tz: str = "UTC"

    def frame(self, t: LineTables, bound: datetime, local_tz: str) -> DataFrame:
        scoped = al.alarm_scope(t.bounded("alarms", bound), bound, self.source_like, self.priorities, self.source_tz, local_tz)
        return al.alarm_count(scoped, self.station, self.label, self.match)

    def alarm_parts(self, alarms: DataFrame, bound: datetime, local_tz: str) -> list[tuple[Column, Column, str, str]]:
        scope = al.alarm_scope_filter(alarms, bound, self.source_like, self.priorities, self.source_tz, local_tz)
        return [(scope & F.col(al.DESCRIPTION).ilike(self.match), F.lit(self.label), self.station, "alarm_description")]


@dataclass(frozen=True)
class TraceCheck:
    """Failing units of one station traced to the origin station of their parts.

    Failing rows: ``failures`` filtered by station, ``fail_where`` and, with
    ``fail_rules``, by being outside those limits. Origin rows: child records
    whose station matches ``origin_like`` (case-sensitive ``like``) and whose
    parameter is ``origin_parameter``.
    """

    fail_station: str | None = None
    fail_station_like: str | None = None
    fail_where: str | None = None
    fail_rules: Sequence[tuple] | None = None
    fail_value_col: str = "parameter_value_raw"
    origin_like: str | None = None
    origin_parameter: str | None = ORIGIN_PARAMETER
    origin_where: str | None = None
    since: datetime | None = None

    def fusable(self) -> bool:
        """Whether one row test says which units fail; a large rules table is joined instead."""
        return self.fail_rules is None or _inline(self.fail_rules) is not None

    def fail_predicate(self, rows: DataFrame, bound: datetime) -> Column:
        """Row test for the failing units; spec limits are compiled inline (``fusable`` ones only)."""
        spec = None
        if self.fail_rules is not None and self.fusable():
            spec = ct.spec_fail_filter(rows, None, _inline(self.fail_rules), value_col=self.fail_value_col)
        return ct._all(
            ct.after(rows, "recorded_at", self.since or bound),
            ct.station_filter(self.fail_station, self.fail_station_like),
            _where(self.fail_where),
            spec,
        )

    def origin_predicate(self) -> Column:
        like = None if self.origin_like is None else F.col("station_name").like(self.origin_like)
        param = None if self.origin_parameter is None else F.col("parameter_name") == self.origin_parameter
        return ct._all(like, param, _where(self.origin_where))

    def failing(self, t: LineTables, bound: datetime) -> DataFrame:
        rows = t.bounded("failures", self.since or bound)
        failing = rows.where(self.fail_predicate(rows, bound))
        return failing if self.fusable() else out_of_spec(failing, self.fail_rules, value_col=self.fail_value_col)

    def origins(self, t: LineTables) -> DataFrame:
        return t.child_rows().where(self.origin_predicate())

    def frame(self, t: LineTables, bound: datetime, local_tz: str) -> DataFrame:
        return trace_origin(self.origins(t), t.genealogy, self.failing(t, bound), buckets=t.child_buckets, runtime_filter=t.trace_filter)


@dataclass(frozen=True)
class LinePlan:
    """All checks of one report.

    ``counts`` feed the fail-count table and the station totals; ``exact``
    gives exact per-station counts that replace the summed totals; ``traces``
    feed the origin table, over genealogy rows passing ``genealogy_where``. ``local_tz`` is the zone of the records' wall
    clock and of ``as_of``.
    """

    counts: tuple = ()
    exact: tuple = ()
    traces: tuple = ()
    genealogy_where: str | None = None
    local_tz: str = LINE_TZ
    shift_end_hours: tuple[int, ...] = SHIFT_END_HOURS

    def __post_init__(self) -> None:
        if not self.counts:
            raise ValueError("a LinePlan needs at least one count check")
