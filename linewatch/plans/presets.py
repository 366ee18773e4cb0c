"""Ready-made plans.

``line_plan`` holds the stations, parameters, alarm kinds and limits of the
stator line this report was written for; the plant and line names are
parameters. ``fixture_plan`` is the same report shape over the fixture views of
the test tables (``linewatch.sources.fixtures``).
"""

from __future__ import annotations

from datetime import datetime

from linewatch.plans.checks import (
    AlarmCountCheck,
    AlarmReportCheck,
    JobCheck,
    LinePlan,
    NokCheck,
    ParamCheck,
    SpecCheck,
    TraceCheck,
)
from linewatch.operators.limits import _sql_text
from linewatch.plans.rules import ELECTRICAL_LIMITS, PIN_TRACE_LIMITS, VISION_LIMITS, VISION_LIMITS_SHIFT
from linewatch.sources.fixtures import FIXTURE_RULES
from linewatch.defaults import LINE_TZ


# The stator line's stations, parameters, alarm patterns and labels, in the order the report uses them.
JOB_STATION = "020"
FORCE_STATION_LIKE = "%40%"
FORCE_PARAMETER = "Force process value"
FORCE_PARAMETER_ID = 2
PLATE_STATION = "050"
PLATE_LABEL = "Twisting Check Plate Fails"
PLATE_ALARM = "%Assembly error%Task[301]%"
GRIPPER_ALARM = "%Gripper%work%"
WELD_STATION = "070"
WELD_LABEL = "Bad Cuts/Welding Fail"
WELD_ALARM = "%Assembly error%"
VISION_STATION = "090"
NOK_STATION = "100"
ELECTRICAL_STATION = "180"
UNIQUE_STATION = "210"
ORIGIN_CONTAINS = "%30%"
ORIGIN_PREFIX = "030%"
PLATE_FAIL_STATION_LIKE = "%050%"


def literal_pattern(text: str) -> str:
    """``text`` with the pattern characters of ``like`` escaped."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def line_plan(
    line: str, shop: str | None = None, shift: bool = False, local_tz: str = LINE_TZ, line_like: str | None = None,
    scopes: dict[str, str] | None = None, exact_unique: bool = False,
) -> LinePlan:
    """The stator line's hourly report (``shift=True``: the shift-summary limits).

    Checks count rows of ``line`` (and ``shop``). ``line_like`` widens all checks
    to lines matching a pattern (case-insensitive), and ``scopes`` gives single
    checks a row test of their own; its keys are ``job``, ``force``, ``vision``,
    ``nok``, ``electrical``, ``unique``, ``trace_force``, ``trace_plate``,
    ``trace_vision``, ``origin``, ``genealogy``. ``exact_unique`` adds the exact
    count of the unique station; it replaces a summed total, and without a count
    check of that station there is none to replace.
    """
    line_test = f"line_name = {_sql_text(line)}" if line_like is None else f"line_name ILIKE {_sql_text(line_like)}"
    default = line_test + (f" AND shop_name = {_sql_text(shop)}" if shop else "")
    own = scopes or {}
    scope = lambda check: own.get(check, default)
    source = literal_pattern(line)
    vision = VISION_LIMITS_SHIFT if shift else VISION_LIMITS
    nok_force = (
        f"overall_process_status = 'NOK' AND parameter_name = {_sql_text(FORCE_PARAMETER)} AND parameter_id = {FORCE_PARAMETER_ID}"
    )
    return LinePlan(
        counts=(
            JobCheck(station=JOB_STATION, where=scope("job")),
            ParamCheck(parameter=FORCE_PARAMETER, station_like=FORCE_STATION_LIKE, parameter_id=FORCE_PARAMETER_ID, where=scope("force")),
            AlarmReportCheck(
                station=PLATE_STATION,
                label=PLATE_LABEL,
                debounce_match=PLATE_ALARM,
                tag_match=GRIPPER_ALARM,
                source_like=f"%{source}-{PLATE_STATION}%",
            ),
            AlarmCountCheck(station=WELD_STATION, label=WELD_LABEL, match=WELD_ALARM, source_like=f"%{source}-{WELD_STATION}%"),
            SpecCheck(rules=vision, station=VISION_STATION, value_col="parameter_value_raw", where=scope("vision")),
            NokCheck(station=NOK_STATION, where=scope("nok")),
            SpecCheck(
                rules=ELECTRICAL_LIMITS, station=ELECTRICAL_STATION, location_col="work_location_id",
                value_col="parameter_value_num", status="NOK", where=scope("electrical"),
            ),
        ),
        exact=(
            SpecCheck(
                rules=ELECTRICAL_LIMITS, station=UNIQUE_STATION, location_col="work_location_name",
                value_col="parameter_value_num", status="NOK", per_station=True, where=scope("unique"),
            ),
        ) if exact_unique else (),
        traces=(
            TraceCheck(fail_station_like=FORCE_STATION_LIKE, fail_where=f"{nok_force} AND {scope('trace_force')}", origin_like=ORIGIN_CONTAINS, origin_where=scope("origin")),
            TraceCheck(
                fail_station_like=PLATE_FAIL_STATION_LIKE, fail_where=f"result_status = 'FAIL' AND {scope('trace_plate')}",
                origin_like=ORIGIN_PREFIX, origin_where=scope("origin"),
            ),
            TraceCheck(fail_station=VISION_STATION, fail_where=scope("trace_vision"), fail_rules=PIN_TRACE_LIMITS, origin_like=ORIGIN_PREFIX, origin_where=scope("origin")),
        ),
        genealogy_where=scope("genealogy"),
        local_tz=local_tz,
    )


# Fixed values for the fixture report.
FIXTURE_AS_OF = datetime(2024, 1, 15, 14, 37)
FIXTURE_FACT_SINCE = datetime(1998, 1, 1)  # jobs and failures come from 1995-2001 orders
FIXTURE_TZ = "America/Chicago"


def fixture_plan() -> LinePlan:
    """The report shape over the fixture views: stations are event types and order priorities."""
    nok = "overall_process_status = 'NOK'"
    return LinePlan(
        counts=(
            JobCheck(station="2-HIGH", since=FIXTURE_FACT_SINCE),
            ParamCheck(parameter="param_5", station_like="%i%", parameter_id=2),
            AlarmReportCheck(
                station="S50", label="Check plate fails", debounce_match="%Assembly error%Task[301]%",
                tag_match="%Gripper%work%", source_like="%LINE1-%",
            ),
            AlarmCountCheck(station="S70", label="Assembly fails", match="%Assembly error%", source_like="%LINE1-click%"),
            SpecCheck(rules=FIXTURE_RULES, station="purchase", value_col="parameter_value_raw"),
            NokCheck(station="error"),
            SpecCheck(rules=FIXTURE_RULES, station="view", location_col="work_location_id", value_col="parameter_value_num", status="NOK"),
        ),
        exact=(
            SpecCheck(
                rules=FIXTURE_RULES, station="click", location_col="work_location_name", value_col="parameter_value_num",
                status="NOK", per_station=True,
            ),
        ),
        traces=(
            TraceCheck(fail_station_like="%URGENT%", fail_where=nok, origin_like="%L%", since=FIXTURE_FACT_SINCE),
            TraceCheck(fail_station_like="%HIGH%", fail_where=nok, origin_like="S%", since=FIXTURE_FACT_SINCE),
            TraceCheck(fail_station="3-MEDIUM", fail_where=nok, origin_like="P%", since=FIXTURE_FACT_SINCE),
        ),
        local_tz=FIXTURE_TZ,
    )
