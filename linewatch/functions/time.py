"""Time-window helpers.

All bounds are computed once on the driver from an explicit ``as_of`` (no wall
clock inside an operator) and enter the plan as literals, so Catalyst folds them
and pushes ``column > literal`` into the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType, TimestampType
from linewatch.defaults import SHIFT_END_HOURS

_TS_FORMAT = "%Y-%m-%d %H:%M:%S.%f"


def window_start(as_of: datetime, hours: int) -> datetime:
    """Lower bound of a look-back window: ``as_of - hours``, cut to the hour."""
    t = as_of - timedelta(hours=hours)
    return t.replace(minute=0, second=0, microsecond=0)


def hour_label(ts: datetime) -> str:
    """``yyyy-MM-dd HH:00`` text of a bound, as shown in report headers."""
    return ts.strftime("%Y-%m-%d %H:00")


def hour_text(col: Column | str) -> Column:
    """``yyyy-MM-dd HH:00`` text of a timestamp column, cut to the hour (the column form of ``hour_label``)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(F.date_trunc("hour", c), "yyyy-MM-dd HH:00")


def ts_literal(value: datetime, like: DataType | None = None) -> Column:
    """A timestamp literal of the same kind as the column it is compared with.

    Wall-clock (NTZ) columns get an NTZ literal, so no session zone is involved;
    instant (LTZ) columns get a literal read in the session zone.
    """
    text = F.lit(value.replace(tzinfo=None).strftime(_TS_FORMAT))
    if isinstance(like, TimestampType):
        return text.cast("timestamp")
    return text.cast("timestamp_ntz")


def _column_type(df: DataFrame, name: str) -> DataType:
    return df.schema[name].dataType


def since(df: DataFrame, ts_col: str, bound: datetime, until: datetime | None = None) -> DataFrame:
    """Rows with ``ts_col > bound`` (strict), and ``ts_col <= until`` if given."""
    kind = _column_type(df, ts_col)
    cond = F.col(ts_col) > ts_literal(bound, kind)
    if until is not None:
        cond = cond & (F.col(ts_col) <= ts_literal(until, kind))
    return df.where(cond)


def local_time(col: Column | str, source_tz: str, target_tz: str) -> Column:
    """Wall clock of ``col`` (read in ``source_tz``) shown in ``target_tz``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.convert_timezone(F.lit(source_tz), F.lit(target_tz), c)


def local_instant(col: Column | str, target_tz: str) -> Column:
    """Wall clock in ``target_tz`` of an instant (``TIMESTAMP``), whatever the session zone."""
    c = F.col(col) if isinstance(col, str) else col
    utc = F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.convert_timezone(F.lit("UTC"), F.lit(target_tz), utc)


def instant_literal(utc: datetime) -> Column:
    """A ``TIMESTAMP`` literal for a naive UTC reading, whatever the session zone."""
    return F.lit(utc.replace(tzinfo=timezone.utc))


def _offsets(tz: str, around: datetime, before: timedelta, after: timedelta) -> list[timedelta]:
    zone = ZoneInfo(tz)
    start = (around - before).replace(tzinfo=timezone.utc)
    steps = int((before + after) / timedelta(minutes=15)) + 1
    return [(start + i * timedelta(minutes=15)).astimezone(zone).utcoffset() for i in range(steps)]


def coarse_source_bound(bound_local: datetime, source_tz: str, target_tz: str) -> datetime:
    """A bound on the raw column implied by ``local_time(col) > bound_local``.

    Every row passing the exact test also passes ``col > result``, so the result
    can be pushed into the scan while the exact test stays as a row filter.
    A zone's offset is within [-12 h, +14 h]; offsets are sampled every 15 min
    around the bound, so daylight-saving and zone-rule changes are covered.
    """
    b = bound_local.replace(tzinfo=None)
    widest = max(_offsets(target_tz, b, timedelta(hours=15), timedelta(hours=15)))
    narrowest = min(_offsets(source_tz, b, timedelta(hours=15), timedelta(hours=40)))
    return b - widest + narrowest - timedelta(minutes=1)


def coarse_source_upper(end_local: datetime, source_tz: str, target_tz: str) -> datetime:
    """A bound on the raw column implied by ``local_time(col) <= end_local`` (the mirror of
    ``coarse_source_bound``): every such row also has ``col < result``."""
    e = end_local.replace(tzinfo=None)
    narrowest = min(_offsets(target_tz, e, timedelta(hours=15), timedelta(hours=15)))
    widest = max(_offsets(source_tz, e, timedelta(hours=40), timedelta(hours=15)))
    return e - narrowest + widest + timedelta(minutes=1)


def until_local(
    df: DataFrame, ts_col: str, end_local: datetime, source_tz: str = "UTC", target_tz: str = "UTC"
) -> Column:
    """Test that ``ts_col``, converted from ``source_tz`` to ``target_tz``, is at or before ``end_local``,
    with a pushable coarse bound on the raw column in front."""
    kind = _column_type(df, ts_col)
    if isinstance(kind, TimestampType):
        coarse = F.col(ts_col) < instant_literal(coarse_source_upper(end_local, "UTC", target_tz))
        return coarse & (local_instant(ts_col, target_tz) <= ts_literal(end_local, TimestampNTZType()))
    coarse = F.col(ts_col) < ts_literal(coarse_source_upper(end_local, source_tz, target_tz), kind)
    exact = local_time(ts_col, source_tz, target_tz) <= ts_literal(end_local, TimestampNTZType())
    return coarse & exact


def after_local(
    df: DataFrame, ts_col: str, bound_local: datetime, source_tz: str = "UTC", target_tz: str = "UTC"
) -> Column:
    """Test that ``ts_col``, converted from ``source_tz`` to ``target_tz``, is after ``bound_local``.

    A filter on a converted column does not reach the scan, so a plain coarse
    bound on the raw column is put in front of the exact test. A ``TIMESTAMP``
    column is an instant: ``source_tz`` and the session zone play no part for it.
    """
    kind = _column_type(df, ts_col)
    if isinstance(kind, TimestampType):
        coarse = F.col(ts_col) > instant_literal(coarse_source_bound(bound_local, "UTC", target_tz))
        return coarse & (local_instant(ts_col, target_tz) > ts_literal(bound_local, TimestampNTZType()))
    coarse = F.col(ts_col) > ts_literal(coarse_source_bound(bound_local, source_tz, target_tz), kind)
    exact = local_time(ts_col, source_tz, target_tz) > ts_literal(bound_local, TimestampNTZType())
    return coarse & exact


def since_local(
    df: DataFrame, ts_col: str, bound_local: datetime, source_tz: str = "UTC", target_tz: str = "UTC"
) -> DataFrame:
    """Rows whose time, converted from ``source_tz`` to ``target_tz``, is after ``bound_local``."""
    return df.where(after_local(df, ts_col, bound_local, source_tz, target_tz))


def shift_end(ts_col: Column | str, tz: str, hours: Iterable[int] = SHIFT_END_HOURS, source_tz: str = "UTC") -> Column:
    """True when the local hour of ``ts_col`` is one of the shift-end hours."""
    return F.hour(local_time(ts_col, source_tz, tz)).isin(list(hours))


def is_shift_end(as_of: datetime, tz: str, hours: Iterable[int] = SHIFT_END_HOURS) -> bool:
    """Driver-side gate for the shift summary: ``as_of`` is a UTC instant."""
    utc = as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)
    return utc.astimezone(ZoneInfo(tz)).hour in set(hours)
