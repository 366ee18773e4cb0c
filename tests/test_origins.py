"""The kept origin table and the run-time filter of traces."""

import os
import re
import tempfile
from dataclasses import replace
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES, _tables
from linewatch.operators.origins import OriginStore
from linewatch.operators.trace import serial_bucket, trace_origin
from linewatch.plans.job import refresh_origins
from linewatch.plans.presets import FIXTURE_AS_OF, fixture_plan, line_plan
from linewatch.plans.reports import origin_trace_report
from test_job import _production_tables
from test_plans import _final_plan, _plan

SF = "/root/testdata/sf0.001"
SCHEMA = "product_serial string, station_name string, parameter_name string, line_name string, recorded_at timestamp_ntz"


def _records(spark, rows):
    return spark.createDataFrame([(s, st, "Nest", "L1", datetime(2024, *when)) for s, st, when in rows], SCHEMA)


def _kept(store, spark):
    return sorted((r.product_serial, r.station_name, r.line_name) for r in store.rows(spark).collect())


def _files(store):
    return sorted(os.path.relpath(os.path.join(d, f), store.root) for d, _, names in os.walk(store.root) for f in names if f.endswith(".parquet"))


@pytest.fixture
def store(tmp_path):
    return OriginStore(str(tmp_path / "origins"), buckets=4, extra="line_name string")


def test_rerun_leaves_the_same_rows(spark, store):
    rows = _records(spark, [("c1", "030-A", (1, 14, 9)), ("c1", "030-A", (1, 14, 10)), ("c2", "030-B", (1, 15, 0)), ("c3", "010", (1, 15, 1)), ("c4", "030-A", (1, 16))])
    for _ in range(3):
        store.update(rows, F.col("station_name").like("030%"), date(2024, 1, 14), date(2024, 1, 15))
    assert _kept(store, spark) == [("c1", "030-A", "L1"), ("c2", "030-B", "L1")]  # no repeats, no other station, no other day
    assert len(_files(store)) == 2


def test_days_follow_late_and_corrected_records(spark, store):
    origin = F.col("station_name").like("030%")
    store.update(_records(spark, [("c1", "030-A", (1, 14)), ("c2", "030-B", (1, 14, 23, 59)), ("c3", "030-A", (1, 15))]), origin, date(2024, 1, 14), date(2024, 1, 15))
    # c2 was really made at station A, c5 came late, and nothing is left of the 15th
    store.update(_records(spark, [("c1", "030-A", (1, 14)), ("c2", "030-A", (1, 14, 23, 59)), ("c5", "030 C/x=1%", (1, 14, 5))]), origin, date(2024, 1, 14), date(2024, 1, 15))
    assert _kept(store, spark) == [("c1", "030-A", "L1"), ("c2", "030-A", "L1"), ("c5", "030 C/x=1%", "L1")]
    store.update(_records(spark, [("c9", "030-A", (2, 1))]), origin, date(2024, 1, 14))
    assert _kept(store, spark) == []  # no origin rows on that day any more


def test_fold_merges_past_months(spark, store):
    origin = F.lit(True)
    rows = [("c1", "030-A", (1, 3)), ("c1", "030-A", (1, 4)), ("c2", "030-A", (1, 31)), ("c3", "030-B", (2, 1)), ("c4", "030-A", (2, 20))]
    store.update(_records(spark, rows), origin, date(2024, 1, 1), date(2024, 2, 20))
    before = {r[:2] for r in _kept(store, spark)}
    for _ in range(2):
        store.fold(spark, date(2024, 2, 20))
        assert {r[:2] for r in _kept(store, spark)} == before
        assert {f.split("/")[0] for f in _files(store)} == {"period=2024-01", "period=2024-02-01", "period=2024-02-20"}
    assert len(_kept(store, spark)) == 4  # c1 stands once in its month
    # a late day of a folded month joins it with the next fold
    store.update(_records(spark, [("c7", "030-A", (1, 9))]), origin, date(2024, 1, 9))
    store.fold(spark, date(2024, 2, 20))
    assert {r[:2] for r in _kept(store, spark)} == before | {("c7", "030-A")}
    assert not any("period=2024-01-" in f for f in _files(store))


def test_empty_store(spark, store):
    store.fold(spark, date(2024, 1, 1))
    assert store.rows(spark).collect() == []
    store.update(_records(spark, [("c1", "030-A", (1, 14))]), F.col("station_name") == "999", date(2024, 1, 14))
    assert store.rows(spark).collect() == []
    with pytest.raises(ValueError):
        OriginStore("x", buckets=12)


def test_report_reads_needed_buckets_and_stations(spark, tmp_path):
    """A plan of the report over the store: stations by a partition filter, buckets by the failing units' children."""
    t = _production_tables(spark)
    plan = line_plan("L1", shop="P1")
    want = sorted(map(tuple, origin_trace_report(t, plan, FIXTURE_AS_OF, 8).collect()))
    kept = OriginStore(str(tmp_path / "o"), 8, "line_name string, shop_name string")
    extra = spark.createDataFrame([(f"x{i}", f"0{i % 5}0-A") for i in range(200)], "product_serial string, station_name string")
    more = extra.select("product_serial", "station_name", F.lit("Nest").alias("parameter_name"), F.lit("L1").alias("line_name"), F.lit("P1").alias("shop_name"), F.lit(datetime(2024, 1, 15)).cast("timestamp_ntz").alias("recorded_at"))
    both = t.records.unionByName(more, allowMissingColumns=True)
    kept.update(both, F.lit(True), date(2024, 1, 15))
    for name in ("records", "genealogy"):
        getattr(t, name).write.parquet(str(tmp_path / name))
        setattr(t, name, spark.read.parquet(str(tmp_path / name)))
    report = origin_trace_report(kept.tables(t), plan, FIXTURE_AS_OF, 8)
    assert want and sorted(map(tuple, report.collect())) == want
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    filters = next(x for x in report._jdf.queryExecution().explainString(mode).splitlines() if x.startswith("PartitionFilters") and "serial_bucket" in x)
    assert "station_name" in filters and "dynamicpruning" in filters, filters


def test_runtime_filter_gives_the_same_report(spark):
    t, plan = _tables(spark, SF), fixture_plan()
    want = sorted(map(tuple, origin_trace_report(replace(t, trace_filter=False), plan, FIXTURE_AS_OF, 1).collect()))
    report = origin_trace_report(replace(t, trace_filter=True), plan, FIXTURE_AS_OF, 1)
    assert sorted(map(tuple, report.collect())) == want
    final = _final_plan(report).split("Initial Plan")[0]
    # genealogy is read once: the filter and the join share the children's exchange
    assert len(re.findall(r"FileScan parquet[^\n]*lineitem", final)) == 1 and "ReusedExchange" in final, final
    # the child scan is filtered in the stage that reads it, before anything of it is shuffled
    lines = final.splitlines()
    at = next(i for i, x in enumerate(lines) if "FileScan parquet" in x and "part.parquet" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-*("))
    above = []
    level = depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < level:
            above.append(x)
            level = depth(x)
    joined = next(i for i, x in enumerate(above) if "BroadcastHashJoin" in x and "_word" in x)
    assert not any("Exchange" in x for x in above[:joined]), final
    # as is the default for a small history, there is no filter
    assert "_word" not in _plan(origin_trace_report(t, plan, FIXTURE_AS_OF, 1))


def test_filter_is_chosen_by_size(spark, monkeypatch):
    from linewatch.operators import trace

    monkeypatch.setattr(trace, "FILTER_FROM_BYTES", 1)
    assert "_word" in _plan(QUERIES["hourly_origin"](spark, SF))


@pytest.mark.parametrize("serial", ["string", "long", "int"])
def test_filter_drops_most_rows_and_no_match(spark, serial):
    children = spark.range(20_000).select(F.col("id").cast(serial).alias("product_serial"), F.concat(F.lit("o"), F.col("id") % 3).alias("station_name"))
    genealogy = spark.range(20_000).select((F.col("id") % 500).alias("product_serial"), F.col("id").cast(serial).alias("scanned_child_serial"))
    failures = spark.createDataFrame([(7, "S"), (8, "S"), (None, "S")], "product_serial long, station_name string")
    forms = [trace_origin(children, genealogy, failures, runtime_filter=f) for f in (False, True)]
    plain, filtered = (sorted(map(tuple, f.collect())) for f in forms)
    assert plain == filtered and len(plain) == 3
    bucketed = children.withColumn("serial_bucket", serial_bucket(F.col("product_serial"), 16))
    assert sorted(map(tuple, trace_origin(bucketed, genealogy, failures, buckets=16).collect())) == plain


def test_serials_of_two_types_still_join(spark):
    children = spark.createDataFrame([("01", "A"), ("2", "B")], "product_serial string, station_name string")
    genealogy = spark.createDataFrame([(9, 1), (9, 2)], "product_serial long, scanned_child_serial long")
    failures = spark.createDataFrame([(9, "S")], "product_serial long, station_name string")
    for form in (False, True):
        assert len(trace_origin(children, genealogy, failures, runtime_filter=form).collect()) == 2


def test_refresh_and_command_line(spark, tmp_path):
    from linewatch.__main__ import main

    t = _production_tables(spark)
    store = OriginStore(str(tmp_path / "kept"), extra="line_name string, shop_name string")
    for _ in range(2):
        refresh_origins(store, t, line_plan("L1", shop="P1"), datetime(2024, 1, 15, 21, 10))
    assert [(r.product_serial, r.station_name) for r in store.rows(spark).collect()] == [("c1", "030-A")]
    args = []
    for name in ("records", "alarms", "jobs", "genealogy"):
        getattr(t, name).write.parquet(str(tmp_path / name))
        args += [f"--{name}", str(tmp_path / name)]
    args += ["--line", "L1", "--shop", "P1", "--as-of", "2024-01-15T21:10:00"]
    lines = []
    for k, more in enumerate(([], ["--origins", str(tmp_path / "cli")], ["--origins", str(tmp_path / "cli"), "--origin-days", "0"])):
        paths = main([*args, *more, "--out", str(tmp_path / f"out{k}"), "--as-lines"])
        lines.append(sorted(r.line for r in spark.read.json(paths[1]).where("section = 'origin'").collect()))
    assert lines[0] and lines[0] == lines[1] == lines[2]
    assert os.path.isdir(tmp_path / "cli")
