"""Registered queries: one per operator, over the fixture views of the test tables.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame over whole
tables. The DuckDB statements that must give the same rows are in
``checks/oracle_sql.py`` under the same keys; column names match.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewatch.functions import as_number, bracket_tag, hour_text, local_time, pair_label, shift_end, since, since_local, spool_code, window_start
from linewatch.operators import alarms as al
from linewatch.operators import counts as ct
from linewatch.operators.limits import out_of_spec, rules_frame
from linewatch.operators.origins import OriginStore, any_origin
from linewatch.operators.totals import override_totals, station_totals
from linewatch.operators.trace import trace_origin
from linewatch.plans import reports as rp
from linewatch.plans.checks import JobCheck, LinePlan, LineTables, TraceCheck
from linewatch.plans.states import HourStates
from linewatch.plans.presets import FIXTURE_AS_OF, FIXTURE_FACT_SINCE, FIXTURE_TZ, fixture_plan
from linewatch.session import checkpoint_root
from linewatch.sources import fixtures as fx
from linewatch.streaming import CorrectedCounts, fail_counts_stream, run_available

AS_OF = FIXTURE_AS_OF
BOUND = window_start(AS_OF, 1)  # 2024-01-15 13:00
SHIFT_HOURS = 8
TZ = FIXTURE_TZ
ASSEMBLY = "%Assembly error%Task[301]%"
GRIPPER = "%Gripper%work%"
NOK = "overall_process_status = 'NOK'"


def _tables(spark: SparkSession, d: str) -> LineTables:
    return LineTables(
        records=fx.records(spark, d),
        alarms=fx.alarms(spark, d),
        jobs=fx.jobs(spark, d),
        genealogy=fx.genealogy(spark, d),
        children=fx.child_records(spark, d),
        failures=fx.failures(spark, d),
    )


def _nok_failures(spark: SparkSession, d: str) -> DataFrame:
    return since(fx.failures(spark, d), "recorded_at", FIXTURE_FACT_SINCE).where(F.expr(NOK))


# ---- filters -------------------------------------------------------------

def recent_records(spark: SparkSession, d: str) -> DataFrame:
    df = since(fx.records(spark, d), "recorded_at", BOUND)
    return df.select(
        "product_serial", "station_name", "parameter_name", "parameter_id", "overall_process_status", "recorded_at",
        as_number("parameter_value_raw").alias("value_num"),
    )


def recent_alarms_local(spark: SparkSession, d: str) -> DataFrame:
    df = since_local(fx.alarms(spark, d), "activated_at", BOUND, "UTC", TZ)
    return df.select("alarm_source", "activated_at", local_time("activated_at", "UTC", TZ).alias("activated_local"))


def alarm_pattern_filter(spark: SparkSession, d: str) -> DataFrame:
    df = fx.alarms(spark, d).where(F.col("alarm_description").ilike(ASSEMBLY))
    return df.select("alarm_source", "activated_at", "alarm_description")


def out_of_spec_rows(spark: SparkSession, d: str) -> DataFrame:
    df = out_of_spec(fx.records(spark, d), fx.fixture_rules(spark), value_col="parameter_value_raw")
    return df.select("product_serial", "station_name", "parameter_name", "recorded_at", as_number("parameter_value_raw").alias("value_num"))


def out_of_spec_by_location(spark: SparkSession, d: str) -> DataFrame:
    df = out_of_spec(fx.records(spark, d), fx.fixture_rules(spark), value_col="parameter_value_num", location_col="work_location_id")
    return df.select("product_serial", "station_name", "parameter_name", "work_location_id", "recorded_at", "parameter_value_num")


# Limits with an open side: (parameter_name, work_location_id, work_location_name, low, high)
ONE_SIDED_RULES = [
    ("param_0", None, None, 20.0, None),
    ("param_1", None, None, None, 40.0),
    ("param_2", 1, "01", 5.0, None),
    ("param_3", None, None, None, None),
]


def one_sided_limits(spark: SparkSession, d: str) -> DataFrame:
    """Rules with NULL bounds, compiled and joined."""
    records, rules = fx.records(spark, d), rules_frame(spark, ONE_SIDED_RULES)
    forms = [
        out_of_spec(records, rules, value_col="parameter_value_num", location_col="work_location_id", max_inline_rules=most).select(
            F.lit(form).alias("form"), "product_serial", "station_name", "parameter_name", "recorded_at"
        )
        for form, most in (("compiled", 500), ("joined", 0))
    ]
    return forms[0].unionByName(forms[1])


def positive_counts(spark: SparkSession, d: str) -> DataFrame:
    a = fx.alarms(spark, d)
    frames = [
        al.alarm_total(a.where(F.col("alarm_source") == src), src, label, match)
        for src, label, match in [
            ("LINE1-view", "door", "Door open"),
            ("LINE1-click", "missing", "%no such alarm%"),
            ("LINE1-error", "assembly", "%Assembly error%"),
        ]
    ]
    return ct.positive_counts(rp.combine_reports(frames))


def shift_end_rows(spark: SparkSession, d: str) -> DataFrame:
    ev = fx._read(spark, d, "events")
    return ev.where(shift_end("ts", TZ)).select("event_id", "ts", local_time("ts", "UTC", TZ).alias("local_ts"))


# ---- scalar functions ----------------------------------------------------

def alarm_tag_extract(spark: SparkSession, d: str) -> DataFrame:
    return fx.alarms(spark, d).select("alarm_source", "activated_at", "alarm_description", bracket_tag("alarm_description").alias("tag"))


def label_coalesce(spark: SparkSession, d: str) -> DataFrame:
    scoped = al.alarm_scope(fx.alarms(spark, d), BOUND, "%LINE1-click%", local_tz=TZ)
    frames = [
        al.alarm_count(scoped, "S70", "Assembly fails", "%Assembly error%"),
        ct.station_nok_counts(fx.records(spark, d), BOUND, station="error"),
    ]
    return rp.merge_labels(rp.combine_reports(frames))


def spool_code_extract(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("PT"), F.col("product_serial").cast("string"), F.lit("-C"), F.col("parameter_value_raw"))
    df = fx.batches(spark, d).select("product_serial", raw.alias("parameter_value_raw"))
    return df.select("product_serial", "parameter_value_raw", spool_code("parameter_value_raw").alias("spool_code"))


def pair_label_extract(spark: SparkSession, d: str) -> DataFrame:
    pair = F.concat(F.lit("S"), F.lpad(F.col("product_serial").cast("string"), 7, "0"), F.lit("& T"), F.lpad(F.col("product_serial").cast("string"), 7, "0"))
    df = fx.batches(spark, d).select("product_serial", pair.alias("pair"))
    return df.select("product_serial", "pair", pair_label("pair").alias("label"))


def hour_text_extract(spark: SparkSession, d: str) -> DataFrame:
    return fx.records(spark, d).select("product_serial", "recorded_at", hour_text("recorded_at").alias("hour"))


def report_json(spark: SparkSession, d: str) -> DataFrame:
    return rp.report_json(rp.report_sections(_tables(spark, d), fixture_plan(), AS_OF, 1))


# ---- joins ---------------------------------------------------------------

def _trace_all(spark: SparkSession, d: str) -> DataFrame:
    return trace_origin(fx.child_records(spark, d), fx.genealogy(spark, d), _nok_failures(spark, d))


def trace_origin_q(spark: SparkSession, d: str) -> DataFrame:
    return _trace_all(spark, d)


def trace_existing(spark: SparkSession, d: str) -> DataFrame:
    """The trace over parents that an alarm-free table holds too (the existence join)."""
    parents = fx.jobs(spark, d).where("job_status = 'OPEN'").select("product_serial")
    return trace_origin(fx.child_records(spark, d), fx.genealogy(spark, d), _nok_failures(spark, d), parents_in=parents)


def _dated_failures(spark: SparkSession, d: str) -> DataFrame:
    """Failures spread over the 16 hours before 16:00 of the report's day, with a measured value."""
    serial = F.col("product_serial")
    return fx.failures(spark, d).select(
        "product_serial", "station_name", "overall_process_status",
        F.concat(F.lit("param_"), (serial % 3).cast("string")).alias("parameter_name"),
        (serial % 120).cast("string").alias("parameter_value_raw"),
        (F.lit("2024-01-15 00:30:00").cast("timestamp_ntz") + F.make_dt_interval(hours=(serial % 16).cast("int"))).alias("recorded_at"),
    )


def hourly_origin_window(spark: SparkSession, d: str) -> DataFrame:
    """The origin report over 1 and over 8 hours: its window reaches the failing rows."""
    t = _tables(spark, d)
    t.failures = _dated_failures(spark, d)
    plan = LinePlan(counts=(JobCheck(),), traces=(TraceCheck(fail_station_like="%HIGH%", fail_where=NOK, origin_like="S%"),), local_tz=TZ)
    parts = [rp.origin_trace_report(t, plan, AS_OF, h).withColumn("hours", F.lit(h)) for h in (1, SHIFT_HOURS)]
    return parts[0].unionByName(parts[1])


def hourly_origin_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The origin report with the run-time filter of failing units' children on the origin side, as for a large history."""
    return rp.origin_trace_report(replace(_tables(spark, d), trace_filter=True), fixture_plan(), AS_OF, 1)


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own for a kept table that a query builds from the given tables."""
    return f"{checkpoint_root(spark)}/{name}/{uuid.uuid4().hex}"


def hourly_origin_kept(spark: SparkSession, d: str) -> DataFrame:
    """The origin report over the kept origin table, after a run over all days, a repeated one, and a fold of the past month."""
    day = F.lit("2023-12-30 06:30:00").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("product_serial") % 5).cast("int"))
    made = fx.child_records(spark, d).withColumn("recorded_at", day)
    plan, store = fixture_plan(), OriginStore(_scratch(spark, "origins"), buckets=4, serial_type="long")
    origin = any_origin([t.origin_predicate() for t in plan.traces])
    store.update(made, origin, date(2023, 12, 30), date(2024, 1, 3))
    store.update(made, origin, date(2024, 1, 2), date(2024, 1, 3))
    store.fold(spark, date(2024, 1, 3))
    return rp.origin_trace_report(store.tables(_tables(spark, d)), plan, AS_OF, 1)


def trace_out_of_spec(spark: SparkSession, d: str) -> DataFrame:
    """The trace of units outside a limit set."""
    t = _tables(spark, d)
    t.failures = _dated_failures(spark, d)
    plan = LinePlan(counts=(JobCheck(),), traces=(TraceCheck(fail_station="2-HIGH", fail_rules=fx.FIXTURE_RULES, origin_like="P%"),), local_tz=TZ)
    return rp.origin_trace_report(t, plan, AS_OF, SHIFT_HOURS)


def override_station_totals(spark: SparkSession, d: str) -> DataFrame:
    t, plan = _tables(spark, d), fixture_plan()
    totals = station_totals(rp.fail_counts(t, plan, AS_OF, 1))
    exact = plan.exact[0].frame(t, BOUND, TZ)
    return override_totals(totals, exact)


# ---- aggregations --------------------------------------------------------

def job_fail_counts(spark: SparkSession, d: str) -> DataFrame:
    return ct.job_fail_counts(fx.jobs(spark, d), FIXTURE_FACT_SINCE, station="2-HIGH")


def param_fail_counts(spark: SparkSession, d: str) -> DataFrame:
    return ct.param_fail_counts(fx.records(spark, d), BOUND, "param_5", station_like="%i%", parameter_id=2)


def station_nok_counts(spark: SparkSession, d: str) -> DataFrame:
    return ct.station_nok_counts(fx.records(spark, d), BOUND)


def out_of_spec_counts(spark: SparkSession, d: str) -> DataFrame:
    return ct.out_of_spec_counts(fx.records(spark, d), fx.fixture_rules(spark), BOUND)


def out_of_spec_location_counts(spark: SparkSession, d: str) -> DataFrame:
    return ct.out_of_spec_location_counts(fx.records(spark, d), fx.fixture_rules(spark), BOUND)


def station_unique_fails(spark: SparkSession, d: str) -> DataFrame:
    return ct.station_unique_fails(fx.records(spark, d), fx.fixture_rules(spark), BOUND)


def alarm_count(spark: SparkSession, d: str) -> DataFrame:
    scoped = al.alarm_scope(fx.alarms(spark, d), BOUND, "%LINE1-click%", local_tz=TZ)
    return al.alarm_count(scoped, "S70", "Assembly fails", "%Assembly error%")


def alarm_tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return al.alarm_tag_counts(fx.alarms(spark, d), "S50", GRIPPER)


def station_pareto(spark: SparkSession, d: str) -> DataFrame:
    return station_totals(rp.fail_counts(_tables(spark, d), fixture_plan(), AS_OF, 1))


def distinct_events(spark: SparkSession, d: str) -> DataFrame:
    return ct.distinct_events(fx.records(spark, d), fx.fixture_rules(spark), BOUND)


# ---- window --------------------------------------------------------------

def alarm_debounce_storm(spark: SparkSession, d: str) -> DataFrame:
    """The debounce with slices cut by number, as for a storm of alarms in one hour of one source."""
    scoped = al.alarm_scope(fx.alarms(spark, d), None, None)
    return al.debounce(scoped, slice_unit="day", slice_rows=100).where(F.col("alarm_description").ilike(ASSEMBLY))


def alarm_debounce(spark: SparkSession, d: str) -> DataFrame:
    scoped = al.alarm_scope(fx.alarms(spark, d), None, None)
    return al.debounce(scoped).where(F.col("alarm_description").ilike(ASSEMBLY))


# ---- sort and set operations ---------------------------------------------

def origin_report(spark: SparkSession, d: str) -> DataFrame:
    """Stations numbered 8, 10, 12, ...: their order as numbers is not that of their texts."""
    number = (6 + 2 * F.substring("station_name", 1, 1).cast("int")).cast("string")
    return rp.origin_report(_trace_all(spark, d).withColumn("station_name", number))


def alarm_report(spark: SparkSession, d: str) -> DataFrame:
    return al.alarm_report(fx.alarms(spark, d), "S50", "Check plate fails", ASSEMBLY, GRIPPER, BOUND, "%LINE1-%", local_tz=TZ)


def combined_report(spark: SparkSession, d: str) -> DataFrame:
    return rp.stacked_counts(_tables(spark, d), fixture_plan(), AS_OF, 1)


# ---- reports -------------------------------------------------------------

def hourly_report(spark: SparkSession, d: str) -> DataFrame:
    return rp.hourly_report(_tables(spark, d), fixture_plan(), AS_OF, 1)


def hourly_pareto(spark: SparkSession, d: str) -> DataFrame:
    return rp.pareto(_tables(spark, d), fixture_plan(), AS_OF, 1)


def hourly_origin(spark: SparkSession, d: str) -> DataFrame:
    return rp.origin_trace_report(_tables(spark, d), fixture_plan(), AS_OF, 1)


def shift_summary(spark: SparkSession, d: str) -> DataFrame:
    return rp.shift_summary(_tables(spark, d), fixture_plan(), AS_OF, SHIFT_HOURS)


def shift_end_run(spark: SparkSession, d: str) -> DataFrame:
    """Both reports of a run at shift end, from one read of each table."""
    return rp.run_sections(_tables(spark, d), [rp.Report("hourly", fixture_plan(), 1), rp.Report("shift", fixture_plan(), SHIFT_HOURS)], AS_OF)


def shift_summary_states(spark: SparkSession, d: str) -> DataFrame:
    """The shift summary merged from kept hour states, which an earlier run made before its last two hours had come."""
    t, plan = _tables(spark, d), fixture_plan()
    states = HourStates(_scratch(spark, "states"), serial_type="long")
    early = replace(t, records=t.records.where(F.col("recorded_at") <= F.lit("2024-01-15 12:20:00").cast("timestamp_ntz")))
    states.refresh(early, [plan], AS_OF, SHIFT_HOURS)
    states.refresh(t, [plan], AS_OF, SHIFT_HOURS)
    return rp.run_sections(t, [rp.Report("shift", plan, SHIFT_HOURS)], AS_OF, states).drop("report")


# ---- streaming -----------------------------------------------------------

def fail_counts_stream_q(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")  # a glob: the stream source wants a folder or pattern
    stream = fail_counts_stream(fx.records_from_events(events), "1 hour", "10 minutes", failing=F.expr(NOK))
    return run_available(spark, stream)


def fail_counts_corrected(spark: SparkSession, d: str) -> DataFrame:
    """Streamed counts of all windows, where a part of the rows of every hour comes in a second run, long after its window."""
    folder = _scratch(spark, "arrivals")
    events = spark.read.parquet(f"{d}/events.parquet")
    counts = CorrectedCounts(f"{folder}/kept", failing=F.expr(NOK))
    for name, part in (("first", F.col("event_id") % 7 != 3), ("second", F.col("event_id") % 7 == 3)):
        events.where(part).write.parquet(f"{folder}/in/{name}")
        stream = fx.records_from_events(spark.readStream.schema(events.schema).parquet(f"{folder}/in/*"))
        counts.run_available(stream, f"corrected_{folder.rsplit('/', 1)[-1]}")
    return counts.counts(stream)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "recent_records": recent_records,
    "recent_alarms_local": recent_alarms_local,
    "alarm_pattern_filter": alarm_pattern_filter,
    "out_of_spec_rows": out_of_spec_rows,
    "out_of_spec_by_location": out_of_spec_by_location,
    "one_sided_limits": one_sided_limits,
    "positive_counts": positive_counts,
    "shift_end_rows": shift_end_rows,
    "alarm_tag_extract": alarm_tag_extract,
    "label_coalesce": label_coalesce,
    "spool_code_extract": spool_code_extract,
    "pair_label_extract": pair_label_extract,
    "hour_text_extract": hour_text_extract,
    "report_json": report_json,
    "trace_origin": trace_origin_q,
    "trace_existing": trace_existing,
    "trace_out_of_spec": trace_out_of_spec,
    "hourly_origin_window": hourly_origin_window,
    "hourly_origin_filtered": hourly_origin_filtered,
    "hourly_origin_kept": hourly_origin_kept,
    "override_station_totals": override_station_totals,
    "job_fail_counts": job_fail_counts,
    "param_fail_counts": param_fail_counts,
    "station_nok_counts": station_nok_counts,
    "out_of_spec_counts": out_of_spec_counts,
    "out_of_spec_location_counts": out_of_spec_location_counts,
    "station_unique_fails": station_unique_fails,
    "alarm_count": alarm_count,
    "alarm_tag_counts": alarm_tag_counts,
    "station_pareto": station_pareto,
    "distinct_events": distinct_events,
    "alarm_debounce": alarm_debounce,
    "alarm_debounce_storm": alarm_debounce_storm,
    "origin_report": origin_report,
    "alarm_report": alarm_report,
    "combined_report": combined_report,
    "hourly_report": hourly_report,
    "hourly_pareto": hourly_pareto,
    "hourly_origin": hourly_origin,
    "shift_summary": shift_summary,
    "shift_end_run": shift_end_run,
    "shift_summary_states": shift_summary_states,
    "fail_counts_stream": fail_counts_stream_q,
    "fail_counts_corrected": fail_counts_corrected,
}
