"""Views that bring the driver's test tables into the shapes the operators read.

The test data has no production-line tables, so each is derived with plain
column expressions (no shuffle) from ``events``, ``orders``, ``lineitem`` and
``part``. ``k`` is the integer in ``events.props`` (``{"k": 0..99}``).
The same views, written for DuckDB, are in ``checks/oracle_sql.py``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def records_from_events(events: DataFrame) -> DataFrame:
    """Process-parameter records; works on a batch or a streaming ``events`` frame."""
    k = F.col("k")
    nok = (k % 5) == 0
    return events.withColumn("k", _k()).select(
        F.col("user_id").alias("product_serial"),
        F.col("event_type").alias("station_name"),
        F.concat(F.lit("param_"), (k % 17).cast("string")).alias("parameter_name"),
        (k % 3).cast("int").alias("parameter_id"),
        (1 + k % 2).cast("int").alias("work_location_id"),
        F.concat(F.lit("0"), (1 + k % 2).cast("string")).alias("work_location_name"),
        F.when(nok, "NOK").otherwise("OK").alias("overall_process_status"),
        F.when(nok, "FAIL").otherwise("PASS").alias("result_status"),
        F.when((k % 25) == 24, F.concat(F.lit("PT"), k.cast("string")))
        .otherwise(F.col("value").cast("string"))
        .alias("parameter_value_raw"),
        F.col("value").alias("parameter_value_num"),
        F.col("ts").alias("recorded_at"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_from_events(_read(spark, sf_dir, "events"))


def alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equipment alarms; ``activated_at``/``cleared_at`` are UTC wall clocks."""
    k = F.col("k")
    return (
        _read(spark, sf_dir, "events")
        .withColumn("k", _k())
        .select(
            F.concat(F.lit("LINE1-"), F.col("event_type")).alias("alarm_source"),
            F.col("ts").alias("activated_at"),
            F.when((k % 7) == 0, F.lit(None)).otherwise(F.col("ts") + F.make_dt_interval(mins=k.cast("int"))).alias("cleared_at"),
            F.when(k % 4 == 0, "low").when(k % 4 == 1, "medium").when(k % 4 == 2, "high").otherwise("critical").alias("alarm_priority"),
            F.when(k % 3 == 0, F.lit("Assembly error on Task[301] step"))
            .when(k % 3 == 1, F.concat(F.lit("Gripper at work pos Key ["), (k % 10).cast("string"), F.lit("]")))
            .otherwise(F.lit("Door open"))
            .alias("alarm_description"),
        )
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station jobs."""
    status = F.col("o_orderstatus")
    return _read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("product_serial"),
        F.col("o_orderpriority").alias("station_name"),
        F.concat(F.lit("loc_"), (F.col("o_orderkey") % 4).cast("string")).alias("work_location_desc"),
        F.when(status == "F", "OK").when(status == "P", "NOK").otherwise("OPEN").alias("job_status"),
        F.col("o_orderdate").alias("started_at"),
    )


def child_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the upstream station that made each child part."""
    return _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_serial"),
        F.col("p_type").alias("station_name"),
        F.lit("Nest").alias("parameter_name"),
    )


def genealogy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent serial <-> consumed child serial."""
    return _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("product_serial"),
        F.col("l_partkey").alias("scanned_child_serial"),
        F.col("l_shipdate").alias("consumed_at"),
    )


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downstream records of finished units."""
    return _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("product_serial"),
        F.col("o_orderpriority").alias("station_name"),
        F.when(F.col("o_orderstatus") == "F", "NOK").otherwise("OK").alias("overall_process_status"),
        F.col("o_orderdate").alias("recorded_at"),
    )


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wire-batch records of child parts."""
    return _read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_serial"),
        F.concat(F.lit("B"), F.col("l_suppkey").cast("string")).alias("parameter_value_raw"),
    )


# The limits table used with the fixture views.
# (parameter_name, work_location_id, work_location_name, low, high)
FIXTURE_RULES = [
    ("param_0", 1, "01", 5.0, 100.0),
    ("param_1", 1, "01", 10.0, 50.0),
    ("param_1", 2, "02", 10.0, 50.0),
    ("param_2", 2, "02", 1.8, 60.5),
]


def fixture_rules(spark: SparkSession) -> DataFrame:
    from linewatch.operators.limits import rules_frame

    return rules_frame(spark, FIXTURE_RULES)


@dataclass
class FixtureTables:
    records: DataFrame
    alarms: DataFrame
    jobs: DataFrame
    genealogy: DataFrame
    children: DataFrame
    failures: DataFrame
    batches: DataFrame


def load_fixtures(spark: SparkSession, sf_dir: str) -> FixtureTables:
    return FixtureTables(
        records=records(spark, sf_dir),
        alarms=alarms(spark, sf_dir),
        jobs=jobs(spark, sf_dir),
        genealogy=genealogy(spark, sf_dir),
        children=child_records(spark, sf_dir),
        failures=failures(spark, sf_dir),
        batches=batches(spark, sf_dir),
    )
