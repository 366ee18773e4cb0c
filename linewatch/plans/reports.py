"""Report compositions: fail-count table, station pareto, origin table, shift summary.

All functions are lazy: they return DataFrames and run no job. Results are
aggregated tables (one row per station and label), so the final sorts and row
numbers are over tiny data. Every report carries ``position``, its rank.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from linewatch.functions.time import coarse_source_bound, instant_literal, ts_literal, window_start
from linewatch.operators import alarms as al
from linewatch.operators.counts import COUNT, after, positive_counts, tagged_counts
from linewatch.operators.trace import trace_origins
from linewatch.plans.checks import JobCheck, LinePlan, LineTables
from linewatch.plans.states import HourStates, mergeable

def combine_reports(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack results by column name; a column missing from one becomes NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_labels(df: DataFrame, label: str = "parameter_name", alt: str = "alarm_description") -> DataFrame:
    """``label`` := first non-NULL of ``alt`` and ``label``; ``alt`` is dropped."""
    if alt not in df.columns:
        return df
    if label not in df.columns:
        return df.withColumnRenamed(alt, label)
    return df.withColumn(label, F.coalesce(F.col(alt), F.col(label))).drop(alt)


def by_count(*tie_breaks: Column | str) -> list[Column]:
    """Most failures first, then the given tie-breaks ascending (equal counts get a fixed order)."""
    return [F.col(COUNT).desc()] + [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in tie_breaks]


def ranked(df: DataFrame, *tie_breaks: Column | str) -> DataFrame:
    """``df`` (a report, so a small aggregated table) in report order, with its ``position`` from 1."""
    position = F.row_number().over(Window.orderBy(*by_count(*tie_breaks)))
    return df.withColumn("position", position).orderBy("position")


def station_number(strict: bool = False) -> Column:
    """The station's name as a number: NULL for another text, or with ``strict`` an error that names the text."""
    name = F.col("station_name")
    if not strict:
        return name.try_cast("int")
    message = F.concat(F.lit("not a station number: "), name)
    return F.when(name.isNotNull() & name.try_cast("int").isNull(), F.raise_error(message).cast("int")).otherwise(name.try_cast("int"))


def origin_report(traces: Sequence[DataFrame] | DataFrame, strict: bool = False) -> DataFrame:
    """Stacked traces, most failures first, then station by number, then origin. ``strict``: stations that are no numbers are an error."""
    df = traces if isinstance(traces, DataFrame) else combine_reports(traces)
    station_num = station_number(strict)
    return ranked(df, station_num.asc_nulls_last(), "station_name", df.columns[-1])


def _bound(as_of: datetime, hours: int) -> datetime:
    return window_start(as_of, hours)


@dataclass(frozen=True)
class Report:
    """One of the reports that a run makes: its name (without a colon), its plan, and how many hours it looks back."""

    name: str
    plan: LinePlan
    hours: int = 1


class _Window(NamedTuple):
    """A report with its lower time bound. Its checks' tags are ``name:n0`` (counts), ``name:x0`` (exact), ``name:t0`` (traces)."""

    name: str
    plan: LinePlan
    bound: datetime

    def checks(self) -> list[tuple[str, object]]:
        return [(f"{self.name}:{kind}{i}", c) for kind, checks in (("n", self.plan.counts), ("x", self.plan.exact)) for i, c in enumerate(checks)]


def _windows(reports: Sequence[Report], as_of: datetime) -> list[_Window]:
    if len({r.name for r in reports}) < len(reports) or any(":" in r.name for r in reports):
        raise ValueError("reports need different names without a colon")
    return [_Window(r.name, r.plan, _bound(as_of, r.hours)) for r in reports]


def _one(plan: LinePlan, as_of: datetime, hours: int) -> list[_Window]:
    return [_Window("r", plan, _bound(as_of, hours))]


def _report() -> Column:
    return F.split_part(F.col("_check"), F.lit(":"), F.lit(1)).alias("report")


def _kind(kind: str) -> Column:
    return F.split_part(F.col("_check"), F.lit(":"), F.lit(2)).startswith(kind)


class _Frames(NamedTuple):
    """Results of the checks of all windows: ``_check``, count, station and labels of each.

    ``fused`` holds all record checks, of both kinds; ``counts`` and ``exact`` those that have a plan of their own.
    """

    counts: list[DataFrame]
    exact: list[DataFrame]
    fused: DataFrame | None


def _fusable(check) -> bool:
    """A record check that can join the shared record pass."""
    return hasattr(check, "fusable") and check.fusable()


def record_checks(windows: Sequence[_Window]) -> list[tuple[str, object, datetime]]:
    """(tag, check, lower bound) of all checks of the shared record pass."""
    return [(tag, c, c.since or w.bound) for w in windows for tag, c in w.checks() if _fusable(c)]


def _record_counts(tables: LineTables, tagged: Sequence[tuple[str, object, datetime]]) -> DataFrame:
    """Counts of many record checks, of any windows, from one scan of ``records`` (``tagged_counts``)."""
    low = min(bound for *_, bound in tagged)
    records = tables.bounded("records", low)
    preds = [(tag, c.predicate(records, bound), c.per_station) for tag, c, bound in tagged]
    # Any check passes: rows without a tag go before they are multiplied, and the optimizer takes the tests that all
    # checks share (line, shop, time) out of the alternatives and pushes them to the scan.
    pre = after(records, "recorded_at", low) & reduce(lambda a, b: a | b, [p for _, p, _ in preds])
    return tagged_counts(records, preds, pre)


def job_checks(windows: Sequence[_Window]) -> list[tuple[str, JobCheck, datetime]]:
    """(tag, check, lower bound) of all job checks."""
    return [(tag, c, c.since or w.bound) for w in windows for tag, c in w.checks() if isinstance(c, JobCheck)]


def _job_counts(tables: LineTables, tagged: Sequence[tuple[str, JobCheck, datetime]]) -> list[DataFrame]:
    """Counts of job checks, of any windows: one scan of ``jobs`` per label column."""
    by_label: dict[str, list[tuple[str, JobCheck, datetime]]] = {}
    for item in tagged:
        by_label.setdefault(item[1].label_col, []).append(item)
    out = []
    for label, tagged in by_label.items():
        low = min(bound for *_, bound in tagged)
        jobs = tables.bounded("jobs", low)
        preds = [(tag, c.predicate(jobs, bound), False) for tag, c, bound in tagged]
        pre = after(jobs, "started_at", low) & reduce(lambda a, b: a | b, [p for _, p, _ in preds])
        counted = tagged_counts(jobs, preds, pre, label_col=label)
        out.append(counted.select("_check", COUNT, "station_name", F.col(label).alias("parameter_name")))
    return out


def _alarm_counts(tables: LineTables, windows: Sequence[_Window]) -> DataFrame | None:
    """Debounced, per-tag and plain alarm counts of all windows from one scan and one exchange of the alarms."""
    alarms = tables.bounded("alarms", min(w.bound for w in windows))
    debounced, plain, shown, lows = [], [], [], []
    instants = isinstance(alarms.schema[al.START].dataType, TimestampType)
    for w in windows:
        for tag, c in w.checks():
            if not hasattr(c, "alarm_parts"):
                continue
            lows.append(coarse_source_bound(w.bound, "UTC" if instants else c.source_tz, w.plan.local_tz))
            if hasattr(c, "debounced"):
                test, *how = c.debounced(alarms, w.bound, w.plan.local_tz)
                debounced.append((f"{tag}.d", test, *how))
                shown.append((f"{tag}.d", c.station, "parameter_name"))
            for j, (test, label, station, label_col) in enumerate(c.alarm_parts(alarms, w.bound, w.plan.local_tz)):
                plain.append((f"{tag}.{j}", test, label))
                shown.append((f"{tag}.{j}", station, label_col))
    if not shown:
        return None
    kind = alarms.schema[al.START].dataType
    low = instant_literal(min(lows)) if instants else ts_literal(min(lows), kind)
    pre = (F.col(al.START) > low) & reduce(lambda a, b: a | b, [d[1] for d in debounced] + [p[1] for p in plain])
    counted = al.alarm_hits(alarms, debounced, plain, pre)
    station = reduce(lambda a, x: a.when(F.col("_check") == x[0], F.lit(x[1])), shown, F.when(F.lit(False), F.lit(None).cast("string")))
    labels = []
    for label_col in ("parameter_name", "alarm_description"):
        tags = [tag for tag, _, col in shown if col == label_col]
        labels.append(F.when(F.col("_check").isin(tags), F.col("_label")).alias(label_col))
    return counted.select("_check", COUNT, station.alias("station_name"), *labels)


def _frames(tables: LineTables, windows: Sequence[_Window], states: HourStates | None = None) -> _Frames:
    """Results of all checks of all windows; with ``states``, those of checks that can be merged from them."""
    jobs, records, kept = job_checks(windows), record_checks(windows), []
    if states is not None:
        kept = [x for x in (*records, *jobs) if mergeable(x[1])]
        jobs, records = ([x for x in own if not mergeable(x[1])] for own in (jobs, records))
    counts, exact = _job_counts(tables, jobs), []
    alarms = _alarm_counts(tables, windows)
    if alarms is not None:
        counts.append(alarms)
    for w in windows:
        for tag, c in w.checks():
            if not (_fusable(c) or isinstance(c, JobCheck) or hasattr(c, "alarm_parts")):
                own = c.frame(tables, w.bound, w.plan.local_tz).withColumn("_check", F.lit(tag))
                (counts if tag.split(":")[1][0] == "n" else exact).append(own)
    fused = [_record_counts(tables, records)] if records else []
    if kept:
        fused.append(states.counts(tables.records.sparkSession, kept))
    return _Frames(counts, exact, reduce(DataFrame.unionByName, fused) if fused else None)


def _stacked(frames: _Frames) -> DataFrame:
    """The count checks' results by column name, with ``report``."""
    rows = list(frames.counts)
    if frames.fused is not None:
        # The test is an aggregate over the tag rather than a filter on it: that would be pushed below the record
        # aggregation, and every reader would have a scan of its own.
        flagged = frames.fused.groupBy("_check", "station_name", "parameter_name").agg(F.max(COUNT).alias(COUNT), F.max(_kind("n")).alias("_keep"))
        rows.append(flagged.where("_keep"))
    stacked = combine_reports([r.select("_check", COUNT, "station_name", *[c for c in ("parameter_name", "alarm_description") if c in r.columns]) for r in rows])
    return stacked.withColumn("report", _report()).drop("_check")


def _fail_counts(frames: _Frames) -> DataFrame:
    return positive_counts(merge_labels(_stacked(frames)))


def stacked_counts(tables: LineTables, plan: LinePlan, as_of: datetime, hours: int = 1) -> DataFrame:
    """All count checks stacked by column name, labels not merged, zeros kept."""
    return _stacked(_frames(tables, _one(plan, as_of, hours))).drop("report")


def _pareto(frames: _Frames) -> DataFrame:
    """Station totals with exact overrides per report, as one aggregation over all result rows.

    Per station: the sum of positive counts of the count checks, replaced by
    the exact count when an exact check gives one; stations without counts get
    no row. The tests are aggregate outputs, so nothing is pushed below the
    shared record aggregation and its shuffle is reused.
    """
    rows = [c.select("_check", F.lit(False).alias("_exact"), "station_name", COUNT) for c in frames.counts]
    rows += [e.select("_check", F.lit(True).alias("_exact"), "station_name", COUNT) for e in frames.exact]
    if frames.fused is not None:
        rows.append(frames.fused.select("_check", _kind("x").alias("_exact"), "station_name", COUNT))
    stacked = reduce(DataFrame.unionByName, rows)
    per_station = stacked.groupBy(_report(), "station_name").agg(
        F.sum(F.when(~F.col("_exact") & (F.col(COUNT) > 0), F.col(COUNT))).alias("_total"),
        F.max(F.when(F.col("_exact"), F.col(COUNT))).alias("_exact_count"),
        F.max(F.col("station_name").isNotNull()).alias("_named"),
    )
    out = per_station.where(F.col("_named") & F.col("_total").isNotNull()).select(
        "report", "station_name", F.coalesce("_exact_count", "_total", F.lit(0)).cast("long").alias(COUNT)
    )
    return positive_counts(out)


def fail_counts(tables: LineTables, plan: LinePlan, as_of: datetime, hours: int = 1) -> DataFrame:
    """All count checks stacked, labels merged, zero counts dropped (unsorted).

    Checks on ``records`` share one scan and one aggregation, alarm counts
    another, and job counts a third.
    """
    return _fail_counts(_frames(tables, _one(plan, as_of, hours))).drop("report")


def hourly_report(tables: LineTables, plan: LinePlan, as_of: datetime, hours: int = 1) -> DataFrame:
    """Fail count by station and parameter, most first."""
    return ranked(fail_counts(tables, plan, as_of, hours), "station_name", "parameter_name")


def pareto(tables: LineTables, plan: LinePlan, as_of: datetime, hours: int = 1) -> DataFrame:
    """Failures per station: summed counts, replaced by exact counts where given, most first."""
    return ranked(_pareto(_frames(tables, _one(plan, as_of, hours))).drop("report"), "station_name")


def _origins(tables: LineTables, windows: Sequence[_Window]) -> list[DataFrame]:
    """Failing units per (station, origin station) over the traces of all windows, with ``report``; one read of each table.

    Windows whose plans read different genealogy rows have a plan each.
    """
    out = []
    by_scope: dict[str | None, list[_Window]] = {}
    for w in windows:
        if w.plan.traces:
            by_scope.setdefault(w.plan.genealogy_where, []).append(w)
    for where, own in by_scope.items():
        traces = [(f"{w.name}:t{i}", t, w) for w in own for i, t in enumerate(w.plan.traces)]
        failures = tables.bounded("failures", min(t.since or w.bound for _, t, w in traces))
        genealogy = tables.genealogy if where is None else tables.genealogy.where(where)
        variants = [(tag, t.fail_predicate(failures, w.bound), t.origin_predicate()) for tag, t, w in traces if t.fusable()]
        if variants:
            traced = trace_origins(tables.child_rows(), genealogy, failures, variants, buckets=tables.child_buckets, runtime_filter=tables.trace_filter)
            out.append(traced.withColumnRenamed("_trace", "_check").withColumn("report", _report()).drop("_check"))
        scoped = replace(tables, genealogy=genealogy)
        out += [t.frame(scoped, w.bound, w.plan.local_tz).withColumn("report", F.lit(w.name)) for _, t, w in traces if not t.fusable()]
    return out


def origin_trace_report(tables: LineTables, plan: LinePlan, as_of: datetime, hours: int = 1, strict: bool = False) -> DataFrame:
    """Failing units per (station, origin station) over all trace checks, most first. ``strict``: see ``origin_report``."""
    if not plan.traces:
        raise ValueError("the plan has no trace checks")
    return origin_report([t.drop("report") for t in _origins(tables, _one(plan, as_of, hours))], strict)


def run_sections(tables: LineTables, reports: Sequence[Report], as_of: datetime, states: HourStates | None = None) -> DataFrame:
    """All tables of several reports in one frame: ``report``, ``section`` and the ``position`` in it, in that order.

    The windows of the reports are tags beside the checks' own, so records, jobs, failures, genealogy, child records and
    alarms are read once for all reports together. ``states``: kept hour states, up to date, that the counts of units come
    from (but for checks with a bound of their own).
    """
    windows = _windows(reports, as_of)
    frames = _frames(tables, windows, states)
    parts = [_fail_counts(frames).withColumn("section", F.lit("parameter")), _pareto(frames).withColumn("section", F.lit("pareto"))]
    parts += [t.withColumn("section", F.lit("origin")) for t in _origins(tables, windows)]
    df = combine_reports(parts)
    if "origin_station" not in df.columns:
        df = df.withColumn("origin_station", F.lit(None).cast("string"))
    number = F.when(F.col("section") == "origin", station_number())
    order = by_count(number.asc_nulls_last(), "station_name", "parameter_name", "origin_station")
    position = F.row_number().over(Window.partitionBy("report", "section").orderBy(*order))
    reports_in_order = F.array_position(F.array(*[F.lit(r.name) for r in reports]), F.col("report"))
    sections_in_order = F.array_position(F.array(*map(F.lit, _SECTION_FIELDS)), F.col("section"))
    out = df.withColumn("position", position).select("report", "section", "position", COUNT, "station_name", "parameter_name", "origin_station")
    return out.orderBy(reports_in_order, sections_in_order, "position")


def report_sections(tables: LineTables, plan: LinePlan, as_of: datetime, hours: int = 1) -> DataFrame:
    """The report tables in one frame, with ``section`` and the ``position`` in it, in report order."""
    return run_sections(tables, [Report("r", plan, hours)], as_of).drop("report")


def shift_summary(tables: LineTables, plan: LinePlan, as_of: datetime, hours: int = 8) -> DataFrame:
    """The report sections over the last shift (8 hours by default)."""
    return report_sections(tables, plan, as_of, hours)


_SECTION_FIELDS = {
    "parameter": ("position", COUNT, "station_name", "parameter_name"),
    "pareto": ("position", "station_name", COUNT),
    "origin": ("position", COUNT, "station_name", "origin_station"),
}


def report_json(sections: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One JSON text line per report row: ``(section, position, line)``, in the rows' order; each section keeps its own
    fields, and a section of another name all of them. ``keep`` names columns that go on beside the line."""
    fields = [c for c in sections.columns if c not in ("section", "window", *keep)]
    line = F.to_json(F.struct(*fields))
    for name, own in _SECTION_FIELDS.items():
        line = F.when(F.col("section") == name, F.to_json(F.struct(*own))).otherwise(line)
    return sections.select("section", "position", line.alias("line"), *keep)
