"""The job entry point, and the production plan on tables with the production columns."""

import tempfile
from datetime import datetime

from pyspark.sql import functions as F

from checks.queries import _tables
from helpers import ALARMS_SCHEMA, JOBS_SCHEMA, RECORDS_SCHEMA
from linewatch.plans.job import local_wall_clock, run_report, write_run
from linewatch.plans.presets import FIXTURE_AS_OF, fixture_plan, line_plan
from linewatch.plans.reports import report_sections
from linewatch.plans.checks import LineTables

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_run_report_uses_local_clock(spark):
    t = _tables(spark, SF)
    plan = fixture_plan()
    as_of_utc = datetime(2024, 1, 15, 20, 37)  # 14:37 in Chicago (UTC-6)
    assert local_wall_clock(as_of_utc, plan.local_tz) == FIXTURE_AS_OF
    run = run_report(t, plan, as_of_utc)
    assert run.shift is None
    assert run.hourly_window == "2024-01-15 13:00 to 14:00"
    assert _rows(run.hourly.drop("window")) == _rows(report_sections(t, plan, FIXTURE_AS_OF, 1))


def test_shift_end_run_writes_both(spark):
    t = _tables(spark, SF)
    run = run_report(t, fixture_plan(), datetime(2024, 1, 15, 21, 10))  # 15:10 local
    assert run.shift is not None and run.shift_window == "2024-01-15 07:00 to 2024-01-15 15:00"
    out = tempfile.mkdtemp(prefix="linewatch-run-")
    paths = write_run(run, out, as_lines=True)
    assert [p.rsplit("/", 1)[-1] for p in paths] == ["hourly", "shift"]
    back = spark.read.json(paths[1])
    assert set(back.columns) == {"section", "position", "line", "window"}
    assert back.count() == run.shift.count()


def _production_tables(spark):
    ts = datetime(2024, 1, 15, 13, 30)
    rec = spark.createDataFrame(
        [
            ("u1", "040", "Force process value", 2, 1, "01", "NOK", "FAIL", "1.0", 1.0, ts),
            ("u2", "090", "Value Height Pin X", 1, 1, "01", "OK", "PASS", "50", 50.0, ts),
            ("u3", "180", "Humidity Value", 1, 2, "02", "NOK", "FAIL", "150", 150.0, ts),
            ("u3", "210", "Humidity Value", 1, 2, "02", "NOK", "FAIL", "150", 150.0, ts),
            ("u4", "100", "Any", 1, 1, "01", "NOK", "FAIL", "1", 1.0, ts),
            ("c1", "030-A", "Nest", 1, 1, "01", "OK", "PASS", "x", None, ts),
            ("u5", "050", "Any", 1, 1, "01", "NOK", "FAIL", "1", 1.0, ts),
        ],
        RECORDS_SCHEMA,
    ).withColumn("line_name", F.lit("L1")).withColumn("shop_name", F.lit("P1"))
    alarms = spark.createDataFrame(
        [("L1-050-A", datetime(2024, 1, 15, 20, 0), None, "high", "Assembly error in Task[301]"),
         ("L1-050-A", datetime(2024, 1, 15, 20, 5), None, "critical", "Gripper at work pos Key [2]"),
         ("L1-070-B", datetime(2024, 1, 15, 20, 6), None, "high", "Assembly error")],
        ALARMS_SCHEMA,
    )
    jobs = spark.createDataFrame([("u9", "020", "loc", "NOK", ts)], JOBS_SCHEMA).withColumn("line_name", F.lit("L1")).withColumn(
        "shop_name", F.lit("P1")
    )
    gen = spark.createDataFrame(
        [("u5", "c1", "L1", "P1"), ("u1", "c1", "L1", "P1"), ("u4", "c1", "L2", "P1")],
        "product_serial string, scanned_child_serial string, line_name string, shop_name string",
    )
    return LineTables(records=rec, alarms=alarms, jobs=jobs, genealogy=gen)


def test_line_plan_runs_on_production_columns(spark):
    tables = _production_tables(spark)
    plan = line_plan("L1", shop="P1")
    got = {(r.section, r.station_name, r.parameter_name, r.origin_station): r.fail_count
           for r in report_sections(tables, plan, datetime(2024, 1, 15, 14, 37), 1).collect()}
    assert got[("parameter", "020", "loc", None)] == 1
    assert got[("parameter", "040", "Force process value", None)] == 1
    assert got[("parameter", "090", "Value Height Pin X", None)] == 1
    assert got[("parameter", "180", "Humidity Value", None)] == 1
    assert got[("parameter", "100", "Any", None)] == 1
    assert got[("parameter", "050", "Twisting Check Plate Fails", None)] == 1
    assert got[("parameter", "050", "2", None)] == 1
    assert got[("parameter", "070", "Bad Cuts/Welding Fail", None)] == 1
    assert got[("pareto", "050", None, None)] == 2
    assert got[("origin", "040", None, "030-A")] == 1
    assert got[("origin", "050", None, "030-A")] == 1


def test_command_line_run(spark, tmp_path):
    from linewatch.__main__ import main

    t = _production_tables(spark)
    args = []
    for name in ("records", "alarms", "jobs", "genealogy"):
        path = str(tmp_path / name)
        getattr(t, name).write.parquet(path)
        args += [f"--{name}", path]
    out = str(tmp_path / "out")
    paths = main(args + ["--line", "L1", "--shop", "P1", "--as-of", "2024-01-15T21:10:00", "--out", out, "--as-lines"])
    assert [p.rsplit("/", 1)[-1] for p in paths] == ["hourly", "shift"]
    # 15:10 local: the hourly bound (14:00) leaves out the 13:30 records; the 8-hour shift section has them all
    shift = [r.line for r in spark.read.json(paths[1]).where("section = 'pareto'").collect()]
    assert '{"position":1,"station_name":"050","fail_count":2}' in shift
    hourly = [r.line for r in spark.read.json(paths[0]).where("section = 'pareto'").collect()]
    # only the alarms at 14:05 (tag) and 14:06 (station 070); the one at 14:00 is not after the bound
    assert hourly == ['{"position":1,"station_name":"050","fail_count":1}', '{"position":2,"station_name":"070","fail_count":1}']


def test_until_gives_an_exact_window(spark):
    from linewatch.plans.reports import fail_counts

    t = _tables(spark, SF)
    plan = fixture_plan()
    end = datetime(2024, 1, 15, 14, 0)
    cut = t.until(end, plan.local_tz)
    assert cut.records.where(F.col("recorded_at") > end).count() == 0
    assert cut.alarms.where(F.convert_timezone(F.lit("UTC"), F.lit(plan.local_tz), "activated_at") > end).count() == 0
    assert cut.failures.where(F.col("recorded_at") > end).count() == 0
    full = {(r.station_name, r.parameter_name): r.fail_count for r in fail_counts(t, plan, FIXTURE_AS_OF, 240).collect()}
    part = {(r.station_name, r.parameter_name): r.fail_count for r in fail_counts(cut, plan, FIXTURE_AS_OF, 240).collect()}
    assert all(k in full and v <= full[k] for k, v in part.items())
    assert sum(part.values()) < sum(full.values())


def test_plan_validation():
    import pytest

    from linewatch.plans.checks import LinePlan, NokCheck
    from linewatch.plans.reports import origin_trace_report

    with pytest.raises(ValueError):
        LinePlan()
    with pytest.raises(ValueError):
        origin_trace_report(None, LinePlan(counts=(NokCheck(),)), FIXTURE_AS_OF)


def test_shift_plan_uses_its_own_limits(spark):
    ts = datetime(2024, 1, 15, 13, 30)
    rec = spark.createDataFrame(
        [("u1", "090", "Value Height Connection Phase 1", 1, 1, "01", "OK", "PASS", "12.0", 12.0, ts)], RECORDS_SCHEMA
    ).withColumn("line_name", F.lit("L1"))
    empty_alarms = spark.createDataFrame([], ALARMS_SCHEMA)
    jobs = spark.createDataFrame([], JOBS_SCHEMA).withColumn("line_name", F.lit("L1"))
    tables = LineTables(records=rec, alarms=empty_alarms, jobs=jobs, genealogy=rec)
    as_of = datetime(2024, 1, 15, 14, 37)
    from linewatch.plans.reports import fail_counts

    hourly = fail_counts(tables, line_plan("L1"), as_of, 1).collect()
    shift = fail_counts(tables, line_plan("L1", shift=True), as_of, 1).collect()
    assert hourly == []  # 12.0 is within 11.35 .. 12.90
    assert [(r.station_name, r.parameter_name, r.fail_count) for r in shift] == [("090", "Value Height Connection Phase 1", 1)]
