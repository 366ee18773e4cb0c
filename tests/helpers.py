"""Small frames for edge-row tests."""

from datetime import datetime

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

RECORDS_SCHEMA = StructType(
    [
        StructField("product_serial", StringType()),
        StructField("station_name", StringType()),
        StructField("parameter_name", StringType()),
        StructField("parameter_id", IntegerType()),
        StructField("work_location_id", IntegerType()),
        StructField("work_location_name", StringType()),
        StructField("overall_process_status", StringType()),
        StructField("result_status", StringType()),
        StructField("parameter_value_raw", StringType()),
        StructField("parameter_value_num", DoubleType()),
        StructField("recorded_at", TimestampNTZType()),
    ]
)

ALARMS_SCHEMA = StructType(
    [
        StructField("alarm_source", StringType()),
        StructField("activated_at", TimestampNTZType()),
        StructField("cleared_at", TimestampNTZType()),
        StructField("alarm_priority", StringType()),
        StructField("alarm_description", StringType()),
    ]
)

JOBS_SCHEMA = StructType(
    [
        StructField("product_serial", StringType()),
        StructField("station_name", StringType()),
        StructField("work_location_desc", StringType()),
        StructField("job_status", StringType()),
        StructField("started_at", TimestampNTZType()),
    ]
)

T0 = datetime(2024, 1, 15, 13, 0)


def record(serial, param="p", value=None, raw=None, station="S1", status="NOK", loc=1, ts=None, pid=2, result="FAIL"):
    raw = raw if raw is not None else (None if value is None else repr(float(value)))
    num = float(value) if value is not None else None
    return (serial, station, param, pid, loc, f"{loc:02d}" if loc is not None else None, status, result, raw, num,
            ts or datetime(2024, 1, 15, 13, 30))


def records(spark, rows):
    return spark.createDataFrame(rows, RECORDS_SCHEMA)


def alarms(spark, rows):
    return spark.createDataFrame(rows, ALARMS_SCHEMA)
