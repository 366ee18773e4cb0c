"""Hand-made edge rows: the decisions of the rebuild, one test each."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import JOBS_SCHEMA, T0, alarms, record, records
from linewatch.functions import bracket_tag, is_shift_end, pair_label, shift_end, since, spool_code, window_start
from linewatch.operators import alarms as al
from linewatch.operators import counts as ct
from linewatch.operators.limits import out_of_spec, rules_frame
from linewatch.operators.totals import override_totals, station_totals
from linewatch.operators.trace import trace_origin, trace_origins
from linewatch.plans import reports as rp

RULES = [("p", 1, 40.0, 46.3), ("q", 1, 0.0, 10.0), ("q", 2, 0.0, 10.0)]


def failing_serials(df):
    return sorted(r.product_serial for r in df.collect())


@pytest.mark.parametrize("inline", [True, False])
def test_limits_edges(spark, inline):
    rows = [
        record("at_low", value=40.0),
        record("at_high", value=46.3),
        record("below", value=39.9),
        record("null_value", value=None),
        record("text", raw="PT00-C"),
        record("text_decimal", raw="40.5"),
        record("loc3", param="q", value=99.0, loc=3),
        record("loc2", param="q", value=99.0, loc=2),
        record("unknown", param="zz", value=-1e9),
    ]
    df = records(spark, rows)
    # inline: the rules compile into one expression; otherwise a semi-join with the rules table
    rules = RULES if inline else rules_frame(spark, RULES)
    got = out_of_spec(df, rules, value_col="parameter_value_raw", location_col="work_location_id", max_inline_rules=500 if inline else 0)
    assert failing_serials(got) == ["below", "loc2"]


def test_strict_bound(spark):
    df = records(spark, [record("at", value=1, ts=T0), record("after", value=1, ts=T0 + timedelta(microseconds=1))])
    assert failing_serials(since(df, "recorded_at", T0)) == ["after"]


def test_window_start():
    assert window_start(datetime(2024, 1, 15, 14, 37), 1) == datetime(2024, 1, 15, 13, 0)
    assert window_start(datetime(2024, 1, 15, 14, 37), 8) == datetime(2024, 1, 15, 6, 0)


def test_distinct_serial_counts(spark):
    rows = [
        record("u1", param="p", value=1.0),  # fails p twice
        record("u1", param="p", value=2.0),
        record("u2", param="p", value=1.0),  # fails p and q
        record("u2", param="q", value=50.0),
    ]
    df = records(spark, rows)
    per_param = {(r.parameter_name): r.fail_count for r in ct.out_of_spec_counts(df, RULES, T0).collect()}
    assert per_param == {"p": 2, "q": 1}
    totals = {r.station_name: r.fail_count for r in station_totals(ct.out_of_spec_counts(df, RULES, T0)).collect()}
    assert totals == {"S1": 3}
    unique = ct.station_unique_fails(df, RULES, T0, location_col=None, value_col="parameter_value_raw")
    assert [(r.station_name, r.fail_count) for r in unique.collect()] == [("S1", 2)]


def test_null_job_status_not_counted(spark):
    jobs = spark.createDataFrame(
        [("a", "020", "loc", None, datetime(2024, 1, 15, 13, 30)), ("b", "020", "loc", "NOK", datetime(2024, 1, 15, 13, 30)),
         ("c", "020", "loc", "OK", datetime(2024, 1, 15, 13, 30))],
        JOBS_SCHEMA,
    )
    got = ct.job_fail_counts(jobs, T0, station="020").collect()
    assert [(r.station_name, r.parameter_name, r.fail_count) for r in got] == [("020", "loc", 1)]


def _alarm(src, start, end, prio="high", desc="Assembly error on Task[301] step"):
    return (src, start, end, prio, desc)


def test_debounce_edges(spark):
    t = datetime(2024, 1, 15, 13, 0)
    s = timedelta(seconds=1)
    rows = [
        _alarm("A", t, t + 10 * s),  # first of source: counts
        _alarm("A", t + 40 * s, None),  # 30 s gap exactly: does not count
        _alarm("A", t + 100 * s, t + 110 * s),  # previous still open: counts
        _alarm("A", t + 120 * s, t + 125 * s, desc="Door open"),  # other description
        _alarm("A", t + 130 * s, t + 131 * s),  # within 30 s of the door alarm: suppressed
        _alarm("A", t + 200 * s, t + 201 * s, prio="low", desc="Door open"),  # low priority: filtered before lag
        _alarm("A", t + 210 * s, t + 211 * s),  # previous kept alarm cleared at +131: counts
        _alarm("B", t + 41 * s, t + 50 * s),  # other source: first, counts
    ]
    df = alarms(spark, rows)
    scoped = al.alarm_scope(df, None, None)
    for unit in ["hour", "minute", "second"]:
        kept = al.debounce(scoped, slice_unit=unit).where(F.col("alarm_description").ilike("%Assembly error%Task[301]%"))
        starts = sorted((r.alarm_source, int((r.activated_at - t).total_seconds())) for r in kept.collect())
        assert starts == [("A", 0), ("A", 100), ("A", 210), ("B", 41)], unit


def test_gap_exactly_30s_not_counted(spark):
    t = datetime(2024, 1, 15, 13, 0)
    df = alarms(spark, [_alarm("A", t, t + timedelta(seconds=10)), _alarm("A", t + timedelta(seconds=40), None)])
    got = al.debounce(df).collect()
    assert [r.activated_at for r in got] == [t]


@pytest.mark.parametrize(
    "text,tag",
    [("Gripper at work pos Key [3]", "3"), ("Gripper at work", ""), ("Gripper at work key [1]", ""), (None, None)],
)
def test_bracket_tag(spark, text, tag):
    got = spark.createDataFrame([(text,)], "d string").select(bracket_tag("d").alias("t")).first().t
    assert got == tag


def test_spool_and_pair_label(spark):
    row = spark.createDataFrame([("PT00649019-C12345678X", "AB123 & CD456")], "s string, p string").select(
        spool_code("s").alias("c"), pair_label("p").alias("l")
    ).first()
    assert row.c == "12345678"
    assert row.l == "AB123 & CD456"


def test_empty_alarm_counts(spark):
    df = alarms(spark, [_alarm("A", datetime(2024, 1, 15, 13, 0), None, desc="Door open")])
    assert al.alarm_count(df, "070", "x", "%Assembly error%").count() == 0
    total = al.alarm_total(df, "050", "x", "%Assembly error%").collect()
    assert [r.fail_count for r in total] == [0]
    assert ct.positive_counts(al.alarm_total(df, "050", "x", "%Assembly error%")).count() == 0


def test_override(spark):
    totals = spark.createDataFrame([("210", 5), ("100", 3), (None, 9)], "station_name string, fail_count long")
    exact = spark.createDataFrame([("210", 2), ("999", 4)], "station_name string, fail_count long")
    got = {r.station_name: r.fail_count for r in override_totals(station_totals(totals), exact).collect()}
    assert got == {"210": 2, "100": 3}


def test_origin_many_children_counts_once(spark):
    children = spark.createDataFrame([("c1", "030A", "Nest"), ("c2", "030A", "Nest"), ("c3", "030A", "Nest")],
                                     "product_serial string, station_name string, parameter_name string")
    gen = spark.createDataFrame([("p1", "c1"), ("p1", "c2"), ("p1", "c3")], "product_serial string, scanned_child_serial string")
    fails = spark.createDataFrame([("p1", "040"), ("p1", "040")], "product_serial string, station_name string")
    got = trace_origin(children, gen, fails).collect()
    assert [(r.station_name, r.origin_station, r.fail_count) for r in got] == [("040", "030A", 1)]
    fused = trace_origins(children, gen, fails, [("t0", F.lit(True), F.lit(True)), ("t1", F.lit(True), F.col("station_name") == "none")]).collect()
    assert [(r._trace, r.fail_count) for r in fused] == [("t0", 1)]


@pytest.mark.parametrize(
    "utc,expected",
    [
        # America/Chicago, winter (UTC-6): 11:59 UTC = 05:59 local, 12:00 = 06:00, 21:00 = 15:00, 22:00 = 16:00
        (datetime(2024, 1, 15, 11, 59), True),
        (datetime(2024, 1, 15, 12, 0), False),
        (datetime(2024, 1, 15, 21, 0), True),
        (datetime(2024, 1, 15, 22, 0), False),
        # summer (UTC-5), both sides of the March change
        (datetime(2024, 3, 10, 7, 30), False),  # 01:30 CST
        (datetime(2024, 3, 10, 10, 30), True),  # 05:30 CDT
        (datetime(2024, 3, 9, 11, 30), True),  # 05:30 CST
    ],
)
def test_shift_end(spark, utc, expected):
    df = spark.createDataFrame([(utc,)], "ts timestamp_ntz")
    assert df.select(shift_end("ts", "America/Chicago").alias("e")).first().e is expected
    assert is_shift_end(utc, "America/Chicago") is expected


def test_merge_labels(spark):
    a = spark.createDataFrame([(1, "070", "Welding")], "fail_count long, station_name string, alarm_description string")
    b = spark.createDataFrame([(2, "100", "Temp")], "fail_count long, station_name string, parameter_name string")
    got = sorted(tuple(r) for r in rp.merge_labels(rp.combine_reports([a, b])).collect())
    assert got == [(1, "070", "Welding"), (2, "100", "Temp")]


def test_trace_with_no_failures(spark):
    children = spark.createDataFrame([("c1", "030A", "Nest")], "product_serial string, station_name string, parameter_name string")
    gen = spark.createDataFrame([("p1", "c1")], "product_serial string, scanned_child_serial string")
    fails = spark.createDataFrame([], "product_serial string, station_name string")
    assert trace_origin(children, gen, fails).count() == 0
    assert trace_origins(children, gen, fails, [("t0", F.lit(True), F.lit(True))]).count() == 0


def test_since_on_instant_column(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 15, 13, 0),), (datetime(2024, 1, 15, 13, 1),)], "ts timestamp")
    assert [r.ts for r in since(df, "ts", T0).collect()] == [datetime(2024, 1, 15, 13, 1)]


def test_trace_existence_join(spark):
    children = spark.createDataFrame([("c1", "030A", "Nest"), ("c2", "030B", "Nest")], "product_serial string, station_name string, parameter_name string")
    gen = spark.createDataFrame([("p1", "c1"), ("p2", "c2")], "product_serial string, scanned_child_serial string")
    fails = spark.createDataFrame([("p1", "040"), ("p2", "040")], "product_serial string, station_name string")
    stacks = spark.createDataFrame([("p2",)], "product_serial string")
    got = trace_origin(children, gen, fails, parents_in=stacks).collect()
    assert [(r.origin_station, r.fail_count) for r in got] == [("030B", 1)]


def test_sources(spark, tmp_path):
    from linewatch.sources import load_table, normalize_columns, write_report

    df = spark.createDataFrame([(1, "a")], "fail_count long, station_name string")
    assert normalize_columns(df).columns == ["FAIL_COUNT", "STATION_NAME"]
    assert normalize_columns(normalize_columns(df), "lower").columns == ["fail_count", "station_name"]
    path = str(tmp_path / "report")
    write_report(df, path, fmt="parquet")
    assert [tuple(r) for r in load_table(spark, path).collect()] == [(1, "a")]
    df.createOrReplaceTempView("lw_report_view")
    assert load_table(spark, "lw_report_view").count() == 1


def test_line_plan_quotes_names():
    from linewatch.plans.presets import line_plan

    plan = line_plan("L'1", shop="P1")
    assert "line_name = 'L\\'1'" in plan.counts[0].where


def test_rule_list_beyond_inline_limit_uses_join(spark):
    df = records(spark, [record("below", value=39.0), record("ok", value=41.0)])
    got = out_of_spec(df, [("p", None, 40.0, float("inf"))], value_col="parameter_value_raw", max_inline_rules=0)
    assert failing_serials(got) == ["below"]
    inline = out_of_spec(df, [("p", None, 40.0, float("inf")), ("p", None, float("-inf"), float("nan"))], value_col="parameter_value_raw")
    assert failing_serials(inline) == ["below"]


def test_decimal_rule_table_compiles(spark):
    from decimal import Decimal

    rules = spark.createDataFrame([("p", Decimal("40.5"), Decimal("46.3"))], "parameter_name string, low decimal(10,2), high decimal(10,2)")
    df = records(spark, [record("below", value=40.4), record("ok", value=40.5)])
    assert failing_serials(out_of_spec(df, rules, value_col="parameter_value_raw")) == ["below"]
    assert failing_serials(out_of_spec(df, rules, value_col="parameter_value_raw", max_inline_rules=0)) == ["below"]


def test_debounce_null_source_is_one_partition(spark):
    t = datetime(2024, 1, 15, 13, 59, 50)
    s = timedelta(seconds=1)
    df = alarms(spark, [_alarm(None, t, t + 20 * s), _alarm(None, t + 30 * s, None)])  # second is in the next hour slice
    got = al.debounce(df).collect()
    assert [r.activated_at for r in got] == [t]


def test_hour_text(spark):
    from linewatch.functions import hour_label, hour_text

    df = spark.createDataFrame([(datetime(2024, 1, 15, 14, 37, 5),)], "ts timestamp_ntz")
    assert df.select(hour_text("ts").alias("h")).first().h == "2024-01-15 14:00"
    assert hour_label(datetime(2024, 1, 15, 14, 37, 5)) == "2024-01-15 14:00"


def test_write_report_partitioned(spark, tmp_path):
    from linewatch.sources import write_report

    df = spark.createDataFrame([("parameter", 1, "S1"), ("pareto", 2, "S1")], "section string, fail_count long, station_name string")
    path = str(tmp_path / "sections")
    write_report(df, path, fmt="parquet", partition_by=["section"])
    back = spark.read.parquet(path).where("section = 'pareto'")
    assert [(r.fail_count, r.station_name) for r in back.collect()] == [(2, "S1")]
