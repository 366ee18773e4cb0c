"""Re-runs, cluster settings, pushed scopes, one-exchange debounce, lazy traces, rule forms."""

import re
import tempfile
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from helpers import JOBS_SCHEMA, RECORDS_SCHEMA, T0, alarms, record, records
from linewatch.operators import alarms as al
from linewatch.operators.limits import out_of_spec, rules_frame
from linewatch.plans.checks import AlarmCountCheck, JobCheck, LinePlan, LineTables, TraceCheck
from linewatch.plans.presets import line_plan, literal_pattern
from linewatch.plans.reports import fail_counts, hourly_report, origin_trace_report, report_sections
from test_job import _production_tables
from test_plans import _final_plan, _plan
from test_stream import SCHEMA, _write

AS_OF = datetime(2024, 1, 15, 14, 37)


def test_incremental_stream_runs_equal_one_batch_count(spark):
    from linewatch.streaming import fail_counts_stream, run_available

    folder, name, rows = tempfile.mkdtemp(prefix="linewatch-stream-"), f"hourly-{time.time_ns()}", []
    for run in range(3):
        new = [(f"u{i % 4}", "S", f"p{i % 2}", datetime(2024, 1, 15, 8, 0) + timedelta(minutes=run * 180 + 11 * i)) for i in range(16)]
        rows += new
        _write(folder, f"{run}.parquet", new)
        events = spark.readStream.schema(SCHEMA).parquet(folder)
        out = run_available(spark, fail_counts_stream(events, "1 hour", "10 minutes"), name=name)
    got = sorted((r.window_start, r.parameter_name, r.fail_count) for r in out.collect())
    closed = max(t for *_, t in rows) - timedelta(minutes=10)
    units = {(t.replace(minute=0), p, u) for u, _, p, t in rows if t.replace(minute=0) + timedelta(hours=1) <= closed}
    want = sorted((w, p, sum(1 for x in units if x[:2] == (w, p))) for w, p in {x[:2] for x in units})
    assert got == want


@pytest.mark.parametrize("form", [500, 0])
def test_open_limits_and_own_location_column(spark, form):
    df = records(spark, [record("low", "p", 1.0), record("mid", "p", 5.0), record("high", "p", 9.0)])
    serials = lambda rules, **k: sorted(r.product_serial for r in out_of_spec(df, rules, max_inline_rules=form, **k).collect())
    assert serials(rules_frame(spark, [("p", None, None, 3.0, None)])) == ["low"]
    assert serials(rules_frame(spark, [("p", None, None, None, 7.0)])) == ["high"]
    assert serials(rules_frame(spark, [("p", None, None, None, None)])) == []
    df = df.withColumn("cell", F.col("product_serial"))
    own = spark.createDataFrame([("p", "high", 2.0, 4.0), ("p", "mid", 6.0, 8.0)], "parameter_name string, cell string, low double, high double")
    assert serials(own, location_col="cell") == ["high", "mid"]
    with pytest.raises(ValueError):
        serials(rules_frame(spark, [("p", None, 2.0, 4.0)]), location_col="cell")
    with pytest.raises(ValueError):
        serials([("p", None, 2.0, 4.0)], location_col="cell")


def test_trace_takes_any_number_of_rules(spark):
    t = _production_tables(spark)
    many = [(f"q{i}", None, 0.0, 1.0) for i in range(600)] + [("Humidity Value", None, 0.0, 100.0)]
    gen = spark.createDataFrame([("u3", "c1")], "product_serial string, scanned_child_serial string")
    t.genealogy = gen
    for rules in (many, rules_frame(spark, many)):
        plan = LinePlan(counts=(JobCheck(),), traces=(TraceCheck(fail_station="210", fail_rules=rules, origin_like="030%"),))
        got = [(r.fail_count, r.station_name, r.origin_station, r.position) for r in origin_trace_report(t, plan, AS_OF, 1).collect()]
        assert got == [(1, "210", "030-A", 1)]


def test_command_line_keeps_the_session_settings(spark, tmp_path):
    from linewatch.__main__ import main

    t, args = _production_tables(spark), []
    for name in ("records", "alarms", "jobs", "genealogy"):
        getattr(t, name).write.parquet(str(tmp_path / name))
        args += [f"--{name}", str(tmp_path / name)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        main(args + ["--line", "L1", "--shop", "P1", "--as-of", "2024-01-15T20:10:00", "--out", str(tmp_path / "out"), "--explain"])
        assert spark.conf.get("spark.sql.shuffle.partitions") == "13"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_checkpoint_root_is_the_configured_folder(spark):
    from linewatch.session import checkpoint_root

    assert checkpoint_root(spark) == checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_scope_reaches_the_scans(spark, tmp_path):
    t = _production_tables(spark)
    for name in ("records", "alarms", "jobs"):
        getattr(t, name).write.parquet(str(tmp_path / name))
        setattr(t, name, spark.read.parquet(str(tmp_path / name)))
    texts = _pushed_filters(hourly_report(t, line_plan("L1", shop="P1"), AS_OF, 1))
    assert any("EqualTo(line_name,L1)" in x and "EqualTo(shop_name,P1)" in x and "recorded_at" in x for x in texts), texts
    assert sum("In(alarm_priority, [high,critical])" in x or "In(alarm_priority, [critical,high])" in x for x in texts) >= 2, texts


def _pushed_filters(df) -> list[str]:
    """The pushed filters of every file scan, from the formatted plan."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"PushedFilters: \[(.*)\]", text)


def test_original_alarm_names(spark):
    t = _production_tables(spark)
    named = t.alarms.withColumnsRenamed({"alarm_source": "alarm_source_scada_short_name", "alarm_priority": "alarm_priority_desc"})
    other = t.alarms.withColumnRenamed("alarm_source", "unit_code")
    want = sorted(tuple(r) for r in fail_counts(t, line_plan("L1", shop="P1"), AS_OF, 1).collect())
    for kwargs in ({"alarms": named}, {"alarms": other, "column_names": {"alarms": {"alarm_source": "unit_code"}}}):
        u = LineTables(records=t.records, jobs=t.jobs, genealogy=t.genealogy, **kwargs)
        assert sorted(tuple(r) for r in fail_counts(u, line_plan("L1", shop="P1"), AS_OF, 1).collect()) == want


def test_line_patterns_and_own_scopes(spark):
    t = _production_tables(spark)
    t.records = t.records.withColumn("line_name", F.when(F.col("product_serial") == "u4", "L1-B").otherwise(F.col("line_name")))
    nok = lambda plan: {(r.station_name, r.parameter_name): r.fail_count for r in fail_counts(t, plan, AS_OF, 1).collect()}.get(("100", "Any"))
    assert nok(line_plan("L1", shop="P1")) is None
    assert nok(line_plan("L1", shop="P1", line_like="%l1%")) == 1
    assert nok(line_plan("L1", shop="P1", scopes={"nok": "line_name ILIKE 'L1%'"})) == 1
    assert literal_pattern("L_1%") == "L\\_1\\%"
    df = alarms(spark, [("LA1-070", T0 + timedelta(hours=7), None, "high", "Assembly error")])
    u = LineTables(records=t.records, alarms=df, jobs=t.jobs, genealogy=t.genealogy)
    got = {r.station_name for r in fail_counts(u, line_plan("L_1"), AS_OF, 1).collect()}
    assert "070" not in got  # the underscore of a line's name is no wildcard


def test_debounce_shuffles_alarms_once(spark, tmp_path):
    rows = [("A" if i % 3 else None, T0 + timedelta(minutes=i % 50), T0 + timedelta(minutes=i % 50, seconds=i % 90), "high", f"d{i % 5}") for i in range(200)]
    alarms(spark, rows).write.parquet(str(tmp_path / "a"))
    df = spark.read.parquet(str(tmp_path / "a"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = al.debounce(df)
        plan = _final_plan(out).split("Initial Plan")[0]
        # one exchange over (source, slice) from the one scan, reused by the summary; the others carry summary rows only
        assert len(re.findall(r"FileScan parquet", plan)) == 1, plan
        dealt = [x for x in plan.splitlines() if "REPARTITION_BY_COL" in x]
        assert sum("ReusedExchange" not in x for x in dealt) == 1 and len(dealt) == 2, plan
        got = sorted(map(tuple, out.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    again = sorted(map(tuple, al.debounce(df.orderBy(F.desc("activated_at"), F.desc("alarm_description"))).collect()), key=repr)
    assert got == again  # alarms that start together: the order of the input plays no part
    ordered, want = {}, []
    key = lambda r: (r[1], r[2], r[4])
    for r in sorted(rows, key=key):
        prev = ordered.get(r[0])
        if prev is None or r[1] > prev + timedelta(seconds=30):
            want.append((*r, prev))
        ordered[r[0]] = r[2]
    assert got == sorted(want, key=repr)


def test_building_a_report_runs_no_job(spark):
    t = _production_tables(spark)
    group = f"build-{time.time_ns()}"
    spark.sparkContext.setJobGroup(group, "building")
    try:
        report_sections(t, line_plan("L1", shop="P1"), AS_OF, 8).explain("formatted")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 0


def test_kept_origin_table_gives_the_same_trace(spark, tmp_path):
    from linewatch.operators.trace import append_origins, child_origins, read_origins

    t = _production_tables(spark)
    plan = line_plan("L1", shop="P1", scopes={"origin": "true"})
    want = sorted(tuple(r) for r in origin_trace_report(t, plan, AS_OF, 8).collect())
    path = str(tmp_path / "origins")
    for _ in range(2):  # a repeated run adds nothing to the counts
        append_origins(child_origins(t.records, F.col("station_name").like("%30%") & (F.col("parameter_name") == "Nest")), path)
    kept = read_origins(spark, path)
    t.children = kept
    report = origin_trace_report(t, plan, AS_OF, 8)
    assert want and sorted(tuple(r) for r in report.collect()) == want
    assert "station_name" in str(re.findall(r"PartitionFilters: \[[^\]]*\]", _plan(report)))


def test_instants_do_not_depend_on_the_session_zone(spark):
    rows = [("LINE1-A", datetime(2024, 1, 15, 19, 30, tzinfo=timezone.utc), None, "high", "Assembly error"),
            ("LINE1-A", datetime(2024, 1, 15, 18, 30, tzinfo=timezone.utc), None, "high", "Assembly error")]
    schema = "alarm_source string, activated_at timestamp, cleared_at timestamp, alarm_priority string, alarm_description string"
    check = AlarmCountCheck(station="S", label="x", match="%Assembly%")
    before = spark.conf.get("spark.sql.session.timeZone")
    empty = spark.createDataFrame([], RECORDS_SCHEMA)
    for zone in ("UTC", "America/Chicago", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            df = spark.createDataFrame(rows, schema)
            t = LineTables(records=empty, alarms=df, jobs=spark.createDataFrame([], JOBS_SCHEMA), genealogy=empty)
            got = [r.fail_count for r in fail_counts(t, LinePlan(counts=(check,)), AS_OF, 1).collect()]  # after 13:00 in Chicago
            cut = t.until(datetime(2024, 1, 15, 13, 0)).alarms.count()
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)
        assert (got, cut) == ([1], 1), zone
