"""One run of the monitoring job: the hourly report, and the shift summary at shift end.

The original job read its clock, ran its queries one after another, and posted
text tables to a chat. Here a run takes the instant explicitly, builds the
report sections as DataFrames and writes them with the DataFrame writer; the
caller's scheduler (cron, a workflow engine, or a streaming trigger) decides
when to run it.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewatch.functions.time import hour_label, is_shift_end, window_start
from linewatch.operators.origins import OriginStore, any_origin
from linewatch.plans.checks import LinePlan, LineTables
from linewatch.plans.reports import Report, report_json, report_sections, run_sections
from linewatch.plans.states import HourStates
from linewatch.sources.sinks import publish


@dataclass
class RunResult:
    """A run's reports. ``sections`` holds both in one frame (``report`` is ``hourly`` or ``shift``), from one read of each table."""

    hourly: DataFrame
    shift: DataFrame | None
    hourly_window: str
    shift_window: str | None
    sections: DataFrame

    def windows(self) -> dict[str, str]:
        return {"hourly": self.hourly_window} | ({} if self.shift_window is None else {"shift": self.shift_window})


def local_wall_clock(instant: datetime, tz: str) -> datetime:
    """A UTC instant (naive means UTC) as a naive wall clock in ``tz``."""
    utc = instant if instant.tzinfo else instant.replace(tzinfo=timezone.utc)
    return utc.astimezone(ZoneInfo(tz)).replace(tzinfo=None)


def refresh_origins(store: OriginStore, tables: LineTables, plan: LinePlan, as_of: datetime, days: int = 2) -> None:
    """Brings the last ``days`` days of origin records (up to the day of ``as_of``, in UTC) into the kept table, and folds past months.

    Each day is replaced as a whole: run it as often as wanted, with as many days as records can be late.
    """
    if not plan.traces:
        return
    today = local_wall_clock(as_of, plan.local_tz).date()
    first = today - timedelta(days=days - 1)
    records = tables.bounded("records", datetime.combine(first, datetime.min.time()))
    store.update(records, any_origin([t.origin_predicate() for t in plan.traces]), first, today)
    store.fold(records.sparkSession, first)


def refresh_states(
    states: HourStates, tables: LineTables, plan: LinePlan, as_of: datetime, shift_plan: LinePlan | None = None, shift_hours: int = 8
) -> list[str]:
    """Brings the hour states of the last shift up to ``as_of`` (in UTC) up to date; returns the hours that were made again."""
    local = local_wall_clock(as_of, plan.local_tz)
    return states.refresh(tables, [plan] if shift_plan is None else [plan, shift_plan], local, shift_hours)


def run_report(
    tables: LineTables,
    plan: LinePlan,
    as_of: datetime,
    shift_plan: LinePlan | None = None,
    hours: int = 1,
    shift_hours: int = 8,
    force_shift: bool = False,
    exact_window: bool = False,
    states: HourStates | None = None,
) -> RunResult:
    """Report sections for the last ``hours`` (and the last shift at shift end).

    ``as_of`` is the run's instant in UTC; bounds are cut to the hour on the
    line's local wall clock (``plan.local_tz``), the clock of the records.
    By default rows up to ``as_of`` count, as in the original; with
    ``exact_window`` only rows up to the last full hour do, matching the label.
    ``states``: kept hour states that ``sections`` takes its counts of units from; bring
    them up to date before (``refresh_states``). They hold the hour of ``as_of`` too, so
    they don't go with ``exact_window``.
    """
    if states is not None and exact_window:
        raise ValueError("hour states hold the current hour, an exact window does not")
    local = local_wall_clock(as_of, plan.local_tz)
    if exact_window:
        tables = tables.until(local.replace(minute=0, second=0, microsecond=0), plan.local_tz)
    window = f"{hour_label(window_start(local, hours))} to {local:%H:00}"
    hourly = report_sections(tables, plan, local, hours).withColumn("window", F.lit(window))
    reports, shift, shift_window = [Report("hourly", plan, hours)], None, None
    if force_shift or is_shift_end(as_of, plan.local_tz, plan.shift_end_hours):
        shift_window = f"{hour_label(window_start(local, shift_hours))} to {local:%Y-%m-%d %H:00}"
        shift = report_sections(tables, shift_plan or plan, local, shift_hours).withColumn("window", F.lit(shift_window))
        reports.append(Report("shift", shift_plan or plan, shift_hours))
    result = RunResult(hourly, shift, window, shift_window, run_sections(tables, reports, local, states))
    label = reduce(lambda a, x: a.when(F.col("report") == x[0], F.lit(x[1])), result.windows().items(), F.when(F.lit(False), F.lit(None).cast("string")))
    result.sections = result.sections.withColumn("window", label)
    return result


def write_run(result: RunResult, out_dir: str, fmt: str = "json", as_lines: bool = False, keep: int = 3) -> list[str]:
    """Write and publish the sections of a run under ``out_dir``; returns the paths of its reports (``hourly``, ``shift``).

    One job writes both reports, so each table is read once. They become visible together (``publish``); readers take
    ``published_report``. ``as_lines`` writes one JSON text line per report row (``report_json``) instead of the section
    columns. The last ``keep`` published runs stay.
    """
    sections = result.sections
    if as_lines:
        line = report_json(sections.withColumnRenamed("report", "_report"), keep=("_report", "window"))
        sections = line.withColumnRenamed("_report", "report")
    return publish(sections, out_dir, "report", list(result.windows()), fmt=fmt, keep=keep)
