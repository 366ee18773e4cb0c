"""A run's tables are the same in all its actions, whatever arrives meanwhile."""

import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpers import record, records
from linewatch.plans.checks import LinePlan, NokCheck
from linewatch.plans.reports import hourly_report, pareto
from linewatch.sources import load_table, pinned
from test_job import _production_tables

AS_OF = datetime(2024, 1, 15, 14, 37)


def _add(spark, path, serials, day="2024-01-15"):
    rows = records(spark, [record(s, "p", 1.0, station="S1") for s in serials]).withColumn("day", F.lit(day))
    rows.write.mode("append").partitionBy("day").parquet(path)


def test_rows_between_two_sections_change_neither(spark, tmp_path):
    path = str(tmp_path / "records")
    _add(spark, path, ["u1", "u2"])
    t, plan = _production_tables(spark), LinePlan(counts=(NokCheck(station="S1"),), local_tz="UTC")
    t.records = load_table(spark, path)
    sections = [hourly_report(t, plan, AS_OF), pareto(t, plan, AS_OF)]
    assert [r.fail_count for r in sections[0].collect()] == [2]
    _add(spark, path, ["u3"])
    _add(spark, path, ["u4"], "2024-01-16")
    assert [r.fail_count for r in sections[1].collect()] == [2]
    t.records = load_table(spark, path)
    assert [r.fail_count for r in pareto(t, plan, AS_OF).collect()] == [4]


def test_a_catalog_table_is_pinned(spark, tmp_path):
    name, path = f"records_{uuid.uuid4().hex}", str(tmp_path / "records")
    rows = records(spark, [record("u1", "p", 1.0), record("u2", "p", 1.0)]).withColumn("day", F.lit("01"))
    rows.write.partitionBy("day").option("path", path).saveAsTable(name)
    try:
        now, live = load_table(spark, name, pin=True), load_table(spark, name)
        assert now.dtypes == live.dtypes and sorted(map(str, now.collect())) == sorted(map(str, live.collect()))
        spark.sql(f"INSERT INTO {name} SELECT * EXCEPT (day), '02' FROM {name}")
        assert (now.count(), load_table(spark, name).count()) == (2, 4)
        assert {r.day for r in now.select("day").collect()} == {"01"}  # a partition value stays text
        later = load_table(spark, name, pin=True).where("day = '02'")
        assert later.count() == 2
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_what_is_no_loaded_table(spark, tmp_path):
    df = records(spark, [record("u1")])
    assert pinned(df) is df
    df.write.parquet(str(tmp_path / "a"))
    a = spark.read.parquet(str(tmp_path / "a"))
    assert pinned(a).collect() == a.collect()
    with pytest.raises(ValueError):
        pinned(a.unionByName(a))
