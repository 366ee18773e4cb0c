"""Hour states: summaries merged from them equal full scans, whatever comes late."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import ALARMS_SCHEMA, JOBS_SCHEMA, record, records
from linewatch.operators.limits import rules_frame
from linewatch.plans.checks import JobCheck, LinePlan, LineTables, NokCheck, ParamCheck, SpecCheck
from linewatch.plans.job import refresh_states, run_report
from linewatch.plans.presets import line_plan
from linewatch.plans.reports import Report, run_sections
from linewatch.plans.states import HourStates, check_key
from test_job import _production_tables

RULES = [("p", None, 0.0, 5.0), ("q", 1, 1.0, 2.0)]
PLAN = LinePlan(
    counts=(JobCheck(station="J"), ParamCheck(parameter="p", parameter_id=2), NokCheck(station="S1"), SpecCheck(rules=RULES, station="S2", value_col="parameter_value_num")),
    exact=(SpecCheck(rules=RULES, station="S1", location_col="work_location_id", value_col="parameter_value_num", status="NOK", per_station=True),),
    local_tz="UTC",
)
AS_OF = datetime(2024, 1, 15, 15, 20)
FIRST = datetime(2024, 1, 15, 6)


def _random(rng, n):
    rows = []
    for _ in range(n):
        ts = FIRST + timedelta(minutes=rng.randrange(0, 600, 20))  # full hours are among them
        rows.append(record(f"u{rng.randrange(25)}", rng.choice("pq"), rng.uniform(-2, 8), station=rng.choice(["S1", "S2", "S3", None]), status=rng.choice(["NOK", "OK", None]), loc=rng.choice([1, 2]), ts=ts))
    return rows


def _jobs(rng, n):
    return [(f"u{rng.randrange(20)}", "J", rng.choice(["a", "b", None]), rng.choice(["OK", "NOK"]), FIRST + timedelta(minutes=rng.randrange(0, 560, 20))) for _ in range(n)]


def _tables(spark, rows, jobs):
    empty = spark.createDataFrame([], ALARMS_SCHEMA)
    return LineTables(records=records(spark, rows), alarms=empty, jobs=spark.createDataFrame(jobs, JOBS_SCHEMA), genealogy=empty)


def _summary(tables, states=None, plan=PLAN, hours=8):
    return [tuple(r) for r in run_sections(tables, [Report("shift", plan, hours)], AS_OF, states).collect()]


def test_merged_states_equal_a_full_scan_with_late_rows(spark, tmp_path):
    rng = random.Random(2)
    states = HourStates(str(tmp_path / "s"))
    rows, jobs = _random(rng, 400), _jobs(rng, 60)
    seen = [r for r in rows if r[-1] <= datetime(2024, 1, 15, 12, 10)]
    early = _tables(spark, seen, [j for j in jobs if j[-1] <= datetime(2024, 1, 15, 12, 10)])
    for hour in range(8, 13):  # hourly runs
        assert f"2024-01-15T{hour:02d}" in states.refresh(early, [PLAN], datetime(2024, 1, 15, hour, 10))
    assert states.refresh(early, [PLAN], datetime(2024, 1, 15, 12, 10)) == ["2024-01-15T12"]
    # the rest of the day, and rows of the hours 8 and 10 that come late
    late = [record("late", "p", 99.0, station="S2", ts=FIRST + timedelta(hours=h, minutes=30)) for h in (2, 4)]
    t = _tables(spark, rows + late, jobs)
    again = states.refresh(t, [PLAN], AS_OF)
    assert {"2024-01-15T08", "2024-01-15T10", "2024-01-15T15"} <= set(again) and "2024-01-15T09" not in again
    want = _summary(t)
    assert want and _summary(t, states) == want
    for hours in (1, 3):
        assert _summary(t, states, hours=hours) == _summary(t, hours=hours)
    # repeated runs leave the same rows
    kept = sorted(map(str, states.read(spark).collect()))
    states.refresh(t, [PLAN], AS_OF)
    assert sorted(map(str, states.read(spark).collect())) == kept


def test_summary_reads_states_only(spark, tmp_path):
    rng = random.Random(6)
    t = _tables(spark, _random(rng, 100), _jobs(rng, 20))
    states = HourStates(str(tmp_path / "s"))
    states.refresh(t, [PLAN], AS_OF)
    want = _summary(t)
    gone = replace(t, records=t.records.limit(0), jobs=t.jobs.limit(0))
    assert _summary(gone, states) == want


def test_a_changed_check_is_made_again(spark, tmp_path):
    rng = random.Random(3)
    t = _tables(spark, _random(rng, 200), _jobs(rng, 30))
    states = HourStates(str(tmp_path / "s"))
    states.refresh(t, [PLAN], AS_OF)
    other = replace(PLAN, counts=(*PLAN.counts[:3], SpecCheck(rules=[("p", None, 0.0, 1.0)], station="S2", value_col="parameter_value_num")))
    assert len(states.refresh(t, [PLAN, other], AS_OF)) == 9
    assert _summary(t, states, other) == _summary(t, plan=other) != _summary(t)
    assert _summary(t, states) == _summary(t)


def test_hours_without_rows_lose_their_old_state(spark, tmp_path):
    states = HourStates(str(tmp_path / "s"))
    one = [record("u1", "p", 9.0, station="S2", ts=FIRST + timedelta(hours=3, minutes=5))]
    jobs = _jobs(random.Random(1), 1)
    states.refresh(_tables(spark, one, jobs), [PLAN], AS_OF)
    empty = _tables(spark, one, jobs)
    empty.records = empty.records.limit(0)
    assert "2024-01-15T09" in states.refresh(empty, [PLAN], AS_OF)
    assert not [r for r in _summary(empty, states) if r[4] == "S2"]


def test_checks_with_their_own_bound_are_scanned(spark, tmp_path):
    rng = random.Random(8)
    t = _tables(spark, _random(rng, 200), _jobs(rng, 30))
    plan = replace(PLAN, counts=(*PLAN.counts, NokCheck(station="S3", since=datetime(2024, 1, 1)), JobCheck(station="J", since=datetime(2024, 1, 1))))
    states = HourStates(str(tmp_path / "s"))
    states.refresh(t, [plan], AS_OF)
    assert _summary(t, states, plan) == _summary(t, plan=plan)


def test_check_keys():
    assert check_key(NokCheck(station="a")) == check_key(NokCheck(station="a")) != check_key(NokCheck(station="b"))
    assert check_key(NokCheck()) != check_key(JobCheck())
    assert check_key(SpecCheck(rules=RULES)) == check_key(SpecCheck(rules=RULES[::-1])) != check_key(SpecCheck(rules=RULES[:1]))


def test_check_key_of_a_rules_table(spark):
    assert check_key(SpecCheck(rules=rules_frame(spark, RULES))) == check_key(SpecCheck(rules=RULES))


def test_run_and_command_line_with_states(spark, tmp_path):
    from linewatch.__main__ import main

    t = _production_tables(spark)
    plan, as_of = line_plan("L1", shop="P1"), datetime(2024, 1, 15, 21, 10)
    shift_plan = line_plan("L1", shop="P1", shift=True)
    states = HourStates(str(tmp_path / "s"))
    assert refresh_states(states, t, plan, as_of, shift_plan)[-1] == "2024-01-15T15"
    rows = [sorted(map(tuple, run_report(t, plan, as_of, shift_plan, states=s).sections.collect()), key=repr) for s in (None, states)]
    assert rows[0] == rows[1]
    with pytest.raises(ValueError):
        run_report(t, plan, as_of, exact_window=True, states=states)
    args = []
    for name in ("records", "alarms", "jobs", "genealogy"):
        getattr(t, name).write.parquet(str(tmp_path / name))
        args += [f"--{name}", str(tmp_path / name)]
    args += ["--line", "L1", "--shop", "P1", "--as-of", "2024-01-15T21:10:00"]
    out = []
    for k, more in enumerate(([], ["--states", str(tmp_path / "cli")])):
        paths = main([*args, *more, "--out", str(tmp_path / f"out{k}")])
        out.append([sorted(map(str, spark.read.json(p).collect())) for p in paths])
    assert out[0] == out[1] and (tmp_path / "cli").is_dir()
