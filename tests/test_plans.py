"""Plan tests: pushed filters, no Python in the plans, one read of each table per report."""

import re

from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _final_plan(df) -> str:
    df.collect()
    return _plan(df)


def test_time_bound_and_rule_names_pushed(spark):
    plan = _plan(QUERIES["out_of_spec_counts"](spark, SF))
    assert "GreaterThan(ts,2024-01-15T13:00)" in plan
    assert re.search(r"PushedFilters: \[[^\]]*IsNotNull\(ts\)", plan)
    assert "Join" not in plan  # small rule sets are compiled, not joined


def test_no_python_in_any_plan(spark):
    for key, fn in QUERIES.items():
        if key == "fail_counts_stream":
            continue
        plan = _plan(fn(spark, SF))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "PythonUDF" not in plan, key


def test_report_reads_records_once(spark):
    plan = _final_plan(QUERIES["shift_summary"](spark, SF))
    final = plan.split("Initial Plan")[0] if "Initial Plan" in plan else plan
    scans = re.findall(r"FileScan parquet [^\n]*?Location: InMemoryFileIndex\(1 paths\)\[file:([^\]]+)\]", final)
    per_table = {}
    for path in scans:
        per_table[path.rsplit("/", 1)[-1]] = per_table.get(path.rsplit("/", 1)[-1], 0) + 1
    # events feeds records (once, reused by the pareto) and alarms (once for debounced, tag and plain counts)
    assert per_table.get("lineitem.parquet") == 1, per_table
    assert per_table.get("part.parquet") == 1, per_table
    assert per_table.get("events.parquet", 0) == 2, per_table
    assert "ReusedExchange" in final


def test_trace_broadcasts_small_failures(spark):
    plan = _final_plan(QUERIES["trace_origin"](spark, SF))
    assert "BroadcastHashJoin" in plan


def test_date_partitions_are_pruned(spark):
    import tempfile

    from pyspark.sql import functions as F

    from checks.queries import _tables
    from linewatch.plans.presets import FIXTURE_AS_OF, fixture_plan
    from linewatch.plans.reports import fail_counts
    from linewatch.sources import fixtures as fx

    path = tempfile.mkdtemp(prefix="linewatch-part-") + "/records"
    fx.records(spark, SF).withColumn("recorded_date", F.to_date("recorded_at")).write.partitionBy("recorded_date").parquet(path)
    t = _tables(spark, SF)
    expected = sorted(tuple(r) for r in fail_counts(t, fixture_plan(), FIXTURE_AS_OF, 240).collect())
    t.records = spark.read.parquet(path)
    t.date_partitions = {"records": "recorded_date"}
    df = fail_counts(t, fixture_plan(), FIXTURE_AS_OF, 240)
    assert sorted(tuple(r) for r in df.collect()) == expected
    plan = _plan(df)
    assert re.search(r"PartitionFilters: \[[^\]]*recorded_date", plan)


def test_hot_groups_are_spread(spark):
    """A group holding most rows is split: the distinct count shuffles on (keys, serial) after a
    map-side dedupe, and the debounce window is partitioned by (source, time slice); only the small
    per-slice summary is partitioned by source alone."""
    counts = _plan(QUERIES["station_nok_counts"](spark, SF))
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", counts)
    assert any("station_name" in k and "product_serial" in k for k in exchanges), exchanges
    assert "partial_count(distinct product_serial" in counts
    debounce = _plan(QUERIES["alarm_debounce"](spark, SF))
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", debounce)
    assert any("_source" in k and "_slice" in k for k in keys), keys
    assert "max_by" in debounce  # the per-slice summary is a (partial) aggregation


def test_rules_table_join_is_broadcast_semi_join(spark):
    from linewatch.operators.limits import out_of_spec, rules_frame
    from linewatch.sources import fixtures as fx

    rules = rules_frame(spark, fx.FIXTURE_RULES)
    df = out_of_spec(fx.records(spark, SF), rules, value_col="parameter_value_num", location_col="work_location_id", max_inline_rules=0)
    plan = _final_plan(df)  # the size is known at run time
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan, plan


def test_size_shuffles(spark):
    from linewatch.session import size_shuffles

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_shuffles(spark, 10 * 1024**3) == 80
        assert spark.conf.get("spark.sql.shuffle.partitions") == "80"
        assert size_shuffles(spark, 1) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_failures_default_to_records_partitions(spark):
    import tempfile
    from datetime import datetime

    from pyspark.sql import functions as F

    from linewatch.plans.checks import LineTables
    from linewatch.sources import fixtures as fx

    path = tempfile.mkdtemp(prefix="linewatch-part-") + "/records"
    fx.records(spark, SF).withColumn("recorded_date", F.to_date("recorded_at")).write.partitionBy("recorded_date").parquet(path)
    rec = spark.read.parquet(path)
    t = LineTables(records=rec, alarms=rec, jobs=rec, genealogy=rec, date_partitions={"records": "recorded_date"})
    plan = _plan(t.bounded("failures", datetime(2024, 1, 20)))
    assert re.search(r"PartitionFilters: \[[^\]]*recorded_date", plan)


def test_local_upper_cut_is_pushed(spark):
    from datetime import datetime

    from checks.queries import _tables

    cut = _tables(spark, SF).until(datetime(2024, 1, 15, 14, 0), "America/Chicago")
    plan = _plan(cut.alarms)
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(ts,", plan), plan
