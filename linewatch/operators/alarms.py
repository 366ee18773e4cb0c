"""Equipment-alarm operators: scoping, debounce, counts and tag counts.

Step order matters and follows the meaning of the original report: time,
source and priority filters come first, then the previous alarm of the same
source is found, then the description filter is applied. So the previous alarm
may be any in-scope alarm of that source, whatever its description.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from linewatch.functions.text import bracket_tag
from linewatch.functions.time import after_local
from linewatch.operators.counts import COUNT
from linewatch.sources.files import estimated_bytes
from linewatch.defaults import ALARM_PRIORITIES, DEBOUNCE_SECONDS, LINE_TZ, TAG_MARKER

SOURCE = "alarm_source"
START = "activated_at"
END = "cleared_at"
PRIORITY = "alarm_priority"
DESCRIPTION = "alarm_description"
COUNTED = (START, END, DESCRIPTION)  # what a debounced count reads


def alarm_scope_filter(
    alarms: DataFrame,
    bound_local: datetime | None = None,
    source_like: str | None = None,
    priorities: Iterable[str] | None = ALARM_PRIORITIES,
    source_tz: str = "UTC",
    local_tz: str = LINE_TZ,
) -> Column:
    """Test for alarms of matching sources and priorities whose local start is after ``bound_local``."""
    conds = []
    if bound_local is not None:
        conds.append(after_local(alarms, START, bound_local, source_tz, local_tz))
    if source_like is not None:
        conds.append(F.col(SOURCE).ilike(source_like))
    if priorities is not None:
        conds.append(F.col(PRIORITY).isin(list(priorities)))
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def alarm_scope(
    alarms: DataFrame,
    bound_local: datetime | None = None,
    source_like: str | None = None,
    priorities: Iterable[str] | None = ALARM_PRIORITIES,
    source_tz: str = "UTC",
    local_tz: str = LINE_TZ,
) -> DataFrame:
    """Alarms of matching sources and priorities whose local start is after ``bound_local``."""
    return alarms.where(alarm_scope_filter(alarms, bound_local, source_like, priorities, source_tz, local_tz))


def tagged_alarm_counts(alarms: DataFrame, checks: Sequence[tuple[str, Column, Column]], prefilter: Column | None = None) -> DataFrame:
    """``COUNT(*)`` per (check, label) for many alarm checks in one scan.

    ``checks`` are ``(tag, row test, label)``. Each alarm is tagged with every
    check it passes, with that check's label, and one aggregation counts them.
    A check with no matching alarm gives no row (as a grouped count does).
    """
    hits = F.array(*[F.when(pred, F.struct(F.lit(tag).alias("check"), label.cast("string").alias("label"))) for tag, pred, label in checks])
    rows = (alarms if prefilter is None else alarms.where(prefilter)).select(F.explode(hits).alias("_hit")).where(F.col("_hit").isNotNull())
    return rows.groupBy(F.col("_hit.check").alias("_check"), F.col("_hit.label").alias("_label")).agg(F.count(F.lit(1)).alias(COUNT))


#: Seconds of the time slices that a window is cut into.
SLICE_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
#: Alarms of at least this estimated size are cut by number too.
SLICE_FROM_BYTES = 1 << 30
#: Alarms in a slice, then; and besides, those of one second.
SLICE_ROWS = 1_000_000


def _micros(df: DataFrame, col: str) -> Column:
    """Microseconds of a time column since 1970 on its own clock; rises with the time in every session zone."""
    if isinstance(df.schema[col].dataType, TimestampType):
        return F.unix_micros(F.col(col))
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(col).cast("timestamp_ntz"))


def _cut_by_number(keyed: DataFrame, keys: Sequence[str], slice_rows: int) -> DataFrame:
    """``keyed`` with ``_part``: the place of the row's second among the parts of its slice, of about ``slice_rows`` rows each.

    The seconds' counts are summed in order within a slice; a part begins with the second at which a multiple of
    ``slice_rows`` is passed. Only slices with several parts are joined back: fewer than (all rows / ``slice_rows``).
    """
    per_second = keyed.groupBy(*keys, "_second").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_second").rowsBetween(Window.unboundedPreceding, -1))
    parts = per_second.withColumn("_part", F.floor(F.coalesce(before, F.lit(0)) / slice_rows)).where("_part > 0")
    begins = parts.groupBy(*keys, "_part").agg(F.min("_second").alias("_begin"))
    cuts = begins.groupBy(*keys).agg(F.collect_list("_begin").alias("_cuts"))
    passed = F.size(F.filter("_cuts", lambda c: c <= F.col("_second")))
    joined = keyed.join(F.broadcast(cuts), list(keys), "left")
    return joined.withColumn("_part", F.when(F.col("_cuts").isNull() | F.col("_second").isNull(), 0).otherwise(passed)).drop("_cuts")


def with_previous_end(
    alarms: DataFrame,
    source_col: str = SOURCE,
    start_col: str = START,
    end_col: str = END,
    slice_unit: str = "hour",
    out: str = "prev_cleared_at",
    keep: Sequence[str] | None = None,
    within: Sequence[str] = (),
    slice_rows: int | None = None,
) -> DataFrame:
    """Adds the end time of the previous alarm (by start time) of the same source.

    Equal to ``lag(end) over (partition by source order by start)``, but the
    window is partitioned by (source, time slice), so one source holding a
    large share of all alarms is spread over many tasks. The first alarm of a
    slice takes the end of the last alarm of the source's previous non-empty
    slice, found from a per-slice summary (one row per source and slice). Alarms
    of one source that start together are ordered by end (NULL first), then
    description. ``keep`` names the columns that the caller reads (default: all).
    ``within`` names columns that separate sources further; they can't be null, and their expressions say so (``coalesce``).

    With ``slice_rows`` a slice with more alarms, such as a storm in one hour of one source, is cut further, at whole
    seconds, into parts of about so many; that takes a count of the alarms first. Default: for alarms of at least
    ``SLICE_FROM_BYTES`` by Spark's estimate, ``SLICE_ROWS``; 0: never.
    """
    # Non-null keys: a NULL source is one partition for lag, so it is one here too, and plain equality joins them.
    keep = list(keep or alarms.columns)
    second = F.floor(_micros(alarms, start_col) / 1_000_000)
    keyed = alarms.withColumns({
        "_source": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "_unnamed": F.col(source_col).isNull(), "_second": second,
        "_slice": F.coalesce(F.floor(second / SLICE_SECONDS[slice_unit]), F.lit(-(1 << 62))),
    })
    sources = [*within, "_source", "_unnamed"]
    places = ["_slice"]
    if slice_rows is None:
        slice_rows = SLICE_ROWS if estimated_bytes(alarms) >= SLICE_FROM_BYTES else 0
    if slice_rows:
        keyed = _cut_by_number(keyed, [*sources, "_slice"], slice_rows)
        places.append("_part")
    keyed = keyed.drop("_second")
    keys = [*sources, *places]
    # Alarms that start together keep one order whatever the order of the input.
    ties = [c for c in (start_col, end_col, DESCRIPTION) if c in alarms.columns]
    # One exchange of the alarms serves the window, the summary and the join.
    dealt = keyed.repartition(*keys)
    by_slice = Window.partitionBy(*keys).orderBy(*ties)
    rows = dealt.withColumns({"_place": F.row_number().over(by_slice), "_prev_end": F.lag(end_col).over(by_slice)})
    # End time of each slice's latest alarm (NULL when it never cleared): one row per source and slice.
    # It takes the columns that the window side takes: with others it would be another scan and exchange.
    last = dealt.groupBy(*keys).agg(F.max_by(F.struct(*dict.fromkeys([*keep, *ties])), F.struct(*ties)).alias("_last")).select(*keys, F.col(f"_last.{end_col}").alias("_last_end"))
    carry = last.select(*keys, F.lag("_last_end").over(Window.partitionBy(*sources).orderBy(*places)).alias("_carry_end"))
    joined = rows.join(carry, keys, "left")
    prev = F.when(F.col("_place") == 1, F.col("_carry_end")).otherwise(F.col("_prev_end"))
    return joined.withColumn(out, prev).select(*keep, out)


def _apart(start: Column, prev: Column, gap_seconds: Column | int) -> Column:
    """Whether an alarm starts more than the gap after the previous one cleared, or that is missing or never cleared."""
    gap = F.lit(gap_seconds) if isinstance(gap_seconds, int) else gap_seconds
    return prev.isNull() | (start > prev + F.make_dt_interval(secs=gap))


def debounce(
    alarms: DataFrame,
    gap_seconds: int = DEBOUNCE_SECONDS,
    source_col: str = SOURCE,
    start_col: str = START,
    end_col: str = END,
    slice_unit: str = "hour",
    keep: Sequence[str] | None = None,
    slice_rows: int | None = None,
) -> DataFrame:
    """Alarms that start more than ``gap_seconds`` after the previous alarm of
    their source cleared, or whose previous alarm is missing or never cleared."""
    df = with_previous_end(alarms, source_col, start_col, end_col, slice_unit, keep=keep, slice_rows=slice_rows)
    return df.where(_apart(F.col(start_col), F.col("prev_cleared_at"), gap_seconds))


def alarm_hits(
    alarms: DataFrame,
    debounced: Sequence[tuple[str, Column, int, str, str]],
    plain: Sequence[tuple[str, Column, Column]],
    prefilter: Column | None = None,
) -> DataFrame:
    """Debounced and plain alarm counts of many checks from one scan and one exchange of the alarms.

    ``debounced`` are ``(tag, scope test, gap seconds, description pattern, label)``: of the alarms in the scope, those that
    match and start more than the gap after the previous alarm of their source in the scope. ``plain`` are ``(tag, row test,
    label)``, as for ``tagged_alarm_counts``. Output: ``_check, _label, fail_count``. A debounced check always has a row, if
    need be with 0; a plain one has a row per label that occurs.
    """
    kinds = [F.struct(F.lit(i).alias("scope"), F.lit(None).cast("string").alias("check"), F.lit(None).cast("string").alias("label")) for i in range(len(debounced))]
    roles = [F.when(test, kind) for kind, (_, test, *_) in zip(kinds, debounced)]
    roles += [F.when(test, F.struct(F.lit(-1).alias("scope"), F.lit(tag).alias("check"), label.cast("string").alias("label"))) for tag, test, label in plain]
    used = alarms if prefilter is None else alarms.where(prefilter)
    # an alarm goes on once for every scope and every plain check that it belongs to
    taken = used.select(SOURCE, *COUNTED, F.explode(F.array(*roles)).alias("_role")).where(F.col("_role").isNotNull())
    taken = taken.select(SOURCE, *COUNTED, F.coalesce("_role.scope", F.lit(-1)).alias("_scope"), F.col("_role.check").alias("_check"), F.col("_role.label").alias("_label"))
    found = with_previous_end(taken, keep=[*COUNTED, "_scope", "_check", "_label"], within=["_scope"])
    check, label = F.col("_check"), F.col("_label")
    for i, (tag, _, gap, match, name) in enumerate(debounced):
        counted = (F.col("_scope") == i) & F.col(DESCRIPTION).ilike(match) & _apart(F.col(START), F.col("prev_cleared_at"), gap)
        check, label = F.when(counted, F.lit(tag)).otherwise(check), F.when(counted, F.lit(name)).otherwise(label)
    hits = found.select(check.alias("_check"), label.alias("_label")).where(F.col("_check").isNotNull())
    counts = hits.groupBy("_check", "_label").agg(F.count(F.lit(1)).alias(COUNT))
    if not debounced:
        return counts
    zeros = F.array(*[F.struct(F.lit(tag).alias("_check"), F.lit(name).alias("_label"), F.lit(0).cast("long").alias(COUNT)) for tag, *_, name in debounced])
    always = alarms.sparkSession.range(1, numPartitions=1).select(F.inline(zeros))
    return counts.unionByName(always).groupBy("_check", "_label").agg(F.sum(COUNT).alias(COUNT))


def alarm_count(alarms: DataFrame, station: str, label: str, match: str | None = None, label_col: str = "alarm_description") -> DataFrame:
    """``COUNT(*)`` of matching alarms grouped by a constant station: no row when nothing matches."""
    df = alarms if match is None else alarms.where(F.col(DESCRIPTION).ilike(match))
    return (
        df.groupBy(F.lit(station).alias("station_name"))
        .agg(F.count(F.lit(1)).alias(COUNT))
        .select(COUNT, "station_name", F.lit(label).alias(label_col))
    )


def alarm_total(alarms: DataFrame, station: str, label: str, match: str | None = None, label_col: str = "parameter_name") -> DataFrame:
    """``COUNT(*)`` of matching alarms without grouping: always one row, possibly 0."""
    df = alarms if match is None else alarms.where(F.col(DESCRIPTION).ilike(match))
    return df.agg(F.count(F.lit(1)).alias(COUNT)).select(COUNT, F.lit(station).alias("station_name"), F.lit(label).alias(label_col))


def alarm_tag_counts(alarms: DataFrame, station: str, match: str | None = None, marker: str = TAG_MARKER) -> DataFrame:
    """``COUNT(*)`` per tag taken from the description after ``marker``."""
    df = alarms if match is None else alarms.where(F.col(DESCRIPTION).ilike(match))
    return (
        df.groupBy(bracket_tag(DESCRIPTION, marker).alias("parameter_name"))
        .agg(F.count(F.lit(1)).alias(COUNT))
        .select(COUNT, F.lit(station).alias("station_name"), "parameter_name")
    )


def alarm_report(
    alarms: DataFrame,
    station: str,
    label: str,
    debounce_match: str,
    tag_match: str,
    bound_local: datetime | None = None,
    source_like: str | None = None,
    priorities: Iterable[str] | None = ALARM_PRIORITIES,
    gap_seconds: int = DEBOUNCE_SECONDS,
    marker: str = TAG_MARKER,
    source_tz: str = "UTC",
    local_tz: str = LINE_TZ,
) -> DataFrame:
    """Debounced count of one alarm kind, stacked over tag counts of another kind; the alarms are read once."""
    scope = alarm_scope_filter(alarms, bound_local, source_like, priorities, source_tz, local_tz)
    tagged = scope & F.col(DESCRIPTION).ilike(tag_match)
    counts = alarm_hits(alarms, [("debounced", scope, gap_seconds, debounce_match, label)], [("tag", tagged, bracket_tag(DESCRIPTION, marker))], scope)
    return counts.select(COUNT, F.lit(station).alias("station_name"), F.col("_label").alias("parameter_name"))
