"""Failure counts: distinct failing units per station and label.

Every count is ``countDistinct(serial)`` over a filtered scan. Spark runs it as
partial aggregation on (keys, serial) -> shuffle on (keys, serial) -> merge ->
partial count -> shuffle on keys -> final count. The first shuffle spreads a
hot (station, parameter) group over all tasks by serial, and repeated rows of
one serial collapse map-side, so a group holding a third of the rows does not
land in one task.

Each check is written once as a row predicate (``*_filter``); the count
functions apply one predicate, and ``tagged_counts`` evaluates many in one
pass over the table.

Output columns are ``fail_count, station_name, <label>``.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewatch.functions.time import ts_literal
from linewatch.operators.limits import Rules, out_of_spec, rule_names, spec_failure
from linewatch.defaults import NOK_STATUS, OK_STATUS

COUNT = "fail_count"


def _all(*conds: Column | None) -> Column:
    present = [c for c in conds if c is not None]
    return reduce(lambda a, b: a & b, present) if present else F.lit(True)


def station_filter(station: str | None = None, station_like: str | None = None, col: str = "station_name") -> Column | None:
    """Exact station, and/or a case-insensitive ``ilike`` pattern; None for every station."""
    conds = []
    if station is not None:
        conds.append(F.col(col) == station)
    if station_like is not None:
        conds.append(F.col(col).ilike(station_like))
    return _all(*conds) if conds else None


def after(df: DataFrame, ts_col: str, bound: datetime | None) -> Column | None:
    """``ts_col > bound`` with a literal of the column's own timestamp kind."""
    if bound is None:
        return None
    return F.col(ts_col) > ts_literal(bound, df.schema[ts_col].dataType)


def distinct_counts(df: DataFrame, keys: list[Column | str], serial_col: str = "product_serial", out: str = COUNT) -> DataFrame:
    """``count(distinct serial)`` per key; the count column first."""
    agg = df.groupBy(*keys).agg(F.countDistinct(serial_col).alias(out))
    return agg.select(out, *[c for c in agg.columns if c != out])


def positive_counts(df: DataFrame, col: str = COUNT) -> DataFrame:
    """Keep rows with a count above zero."""
    return df.where(F.col(col) > 0)


# ---- row predicates ------------------------------------------------------

def job_fail_filter(
    jobs: DataFrame, bound: datetime | None, station: str | None = None, station_like: str | None = None,
    ok_status: str = OK_STATUS, where: Column | None = None,
) -> Column:
    """Job not OK (a NULL status is not counted: ``!=`` is NULL for it)."""
    return _all(after(jobs, "started_at", bound), station_filter(station, station_like), F.col("job_status") != ok_status, where)


def param_fail_filter(
    records: DataFrame, bound: datetime | None, parameter: str, station: str | None = None, station_like: str | None = None,
    parameter_id: int | None = None, status: str = NOK_STATUS, where: Column | None = None,
) -> Column:
    """Status ``status`` on one named parameter (and id)."""
    pid = None if parameter_id is None else F.col("parameter_id") == parameter_id
    return _all(
        after(records, "recorded_at", bound), station_filter(station, station_like),
        F.col("parameter_name") == parameter, pid, F.col("overall_process_status") == status, where,
    )


def nok_filter(
    records: DataFrame, bound: datetime | None, station: str | None = None, station_like: str | None = None,
    status: str = NOK_STATUS, where: Column | None = None,
) -> Column:
    """Status ``status`` on any parameter."""
    return _all(after(records, "recorded_at", bound), station_filter(station, station_like), F.col("overall_process_status") == status, where)


def spec_fail_filter(
    records: DataFrame, bound: datetime | None, rows: Sequence[tuple], station: str | None = None,
    station_like: str | None = None, value_col: str = "parameter_value_raw", location_col: str | None = None,
    status: str | None = None, where: Column | None = None,
) -> Column:
    """Outside a (small, inline) rule set; status tested only when given."""
    st = None if status is None else F.col("overall_process_status") == status
    return _all(
        after(records, "recorded_at", bound), station_filter(station, station_like), st, where,
        F.col("parameter_name").isin(rule_names(rows)), spec_failure(rows, value_col, location_col),
    )


# ---- single counts -------------------------------------------------------

def job_fail_counts(
    jobs: DataFrame, bound: datetime | None, station: str | None = None, station_like: str | None = None,
    ok_status: str = OK_STATUS, label_col: str = "work_location_desc", where: Column | None = None,
) -> DataFrame:
    """Units whose job status is not ``ok_status``, per station and work-location label."""
    df = jobs.where(job_fail_filter(jobs, bound, station, station_like, ok_status, where))
    return distinct_counts(df, ["station_name", F.col(label_col).alias("parameter_name")])


def param_fail_counts(
    records: DataFrame, bound: datetime | None, parameter: str, station: str | None = None, station_like: str | None = None,
    parameter_id: int | None = None, status: str = NOK_STATUS, where: Column | None = None,
) -> DataFrame:
    """Units with status ``status`` for one named parameter (and id), per station."""
    df = records.where(param_fail_filter(records, bound, parameter, station, station_like, parameter_id, status, where))
    return distinct_counts(df, ["station_name", "parameter_name"])


def station_nok_counts(
    records: DataFrame, bound: datetime | None, station: str | None = None, station_like: str | None = None,
    status: str = NOK_STATUS, where: Column | None = None,
) -> DataFrame:
    """Units with status ``status`` per station and parameter."""
    df = records.where(nok_filter(records, bound, station, station_like, status, where))
    return distinct_counts(df, ["station_name", "parameter_name"])


def _failing(
    records: DataFrame, rules: Rules, bound: datetime | None, station: str | None, station_like: str | None,
    status: str | None, value_col: str, location_col: str | None, where: Column | None,
) -> DataFrame:
    st = None if status is None else F.col("overall_process_status") == status
    df = records.where(_all(after(records, "recorded_at", bound), station_filter(station, station_like), st, where))
    return out_of_spec(df, rules, value_col=value_col, location_col=location_col)


def out_of_spec_counts(
    records: DataFrame, rules: Rules, bound: datetime | None, station: str | None = None, station_like: str | None = None,
    value_col: str = "parameter_value_raw", status: str | None = None, where: Column | None = None,
) -> DataFrame:
    """Units outside the limits per station and parameter (status not tested by default)."""
    df = _failing(records, rules, bound, station, station_like, status, value_col, None, where)
    return distinct_counts(df, ["station_name", "parameter_name"])


def out_of_spec_location_counts(
    records: DataFrame, rules: Rules, bound: datetime | None, station: str | None = None, station_like: str | None = None,
    location_col: str = "work_location_id", value_col: str = "parameter_value_num", status: str | None = NOK_STATUS,
    where: Column | None = None,
) -> DataFrame:
    """Units with status ``status`` and outside a location-bound limit, per station and parameter."""
    df = _failing(records, rules, bound, station, station_like, status, value_col, location_col, where)
    return distinct_counts(df, ["station_name", "parameter_name"])


def station_unique_fails(
    records: DataFrame, rules: Rules, bound: datetime | None, station: str | None = None, station_like: str | None = None,
    location_col: str | None = "work_location_name", value_col: str = "parameter_value_num", status: str | None = NOK_STATUS,
    where: Column | None = None,
) -> DataFrame:
    """Units failing any rule, per station: each unit once, however many parameters it fails."""
    df = _failing(records, rules, bound, station, station_like, status, value_col, location_col, where)
    return distinct_counts(df, ["station_name"])


def distinct_events(
    records: DataFrame, rules: Rules, bound: datetime | None, station: str | None = None, station_like: str | None = None,
    value_col: str = "parameter_value_raw", location_col: str | None = None, status: str | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Distinct (serial, station, parameter, time) of out-of-limit measurements."""
    df = _failing(records, rules, bound, station, station_like, status, value_col, location_col, where)
    return df.select("product_serial", "station_name", "parameter_name", "recorded_at").distinct()


# ---- many counts in one pass ---------------------------------------------

def tagged_counts(
    df: DataFrame,
    checks: Sequence[tuple[str, Column, bool]],
    prefilter: Column | None = None,
    serial_col: str = "product_serial",
    label_col: str = "parameter_name",
) -> DataFrame:
    """Distinct serials per (check, station, label) for many checks in one scan.

    ``checks`` are ``(tag, predicate, per_station)``; a per-station check
    counts per station only (label NULL). Each row is tagged with every check
    it passes (usually one) and exploded, so one aggregation serves all checks.
    ``prefilter`` is a pushable superset of the predicates (time bound,
    stations) that reaches the scan.
    """
    # explode, then drop the NULL tags: stays inside whole-stage codegen (array_compact would not)
    tags = F.array(*[F.when(pred, F.lit(tag)) for tag, pred, _ in checks])
    per_station = [tag for tag, _, flag in checks if flag]
    rows = (
        (df if prefilter is None else df.where(prefilter))
        .select(serial_col, "station_name", label_col, F.explode(tags).alias("_check"))
        .where(F.col("_check").isNotNull())
    )
    label = F.when(F.col("_check").isin(per_station), F.lit(None).cast("string")).otherwise(F.col(label_col)) if per_station else F.col(label_col)
    counted = rows.groupBy("_check", "station_name", label.alias(label_col)).agg(F.countDistinct(serial_col).alias(COUNT))
    return counted.select("_check", COUNT, "station_name", label_col)


def split_tagged(counted: DataFrame, prefix: str) -> DataFrame:
    """Rows of ``tagged_counts`` whose tag starts with ``prefix``.

    The test is an aggregate over the tag rather than a filter on it: a
    filter on a grouping column is pushed below the aggregation, which would
    give each caller its own scan; this way all callers share one.
    """
    flagged = counted.groupBy("_check", "station_name", "parameter_name").agg(
        F.max(COUNT).alias(COUNT), F.max(F.col("_check").startswith(prefix)).alias("_keep")
    )
    return flagged.where("_keep").select(COUNT, "station_name", "parameter_name")
