"""Spec limits as data.

A rules row is ``(parameter_name, location_id, location_name, low, high)``. A
measurement fails when its value is below ``low`` or above ``high`` for a rule
of its parameter (and location, when the rule names one). The limits
themselves pass, a NULL or unreadable value never fails, and a row failing two
rules is kept once: the meaning of a chain of ``OR``-ed ranges, for any number
of rules.

Two physical forms, chosen by the size of the rule set:

* up to ``MAX_INLINE_RULES`` rules (a Python list, or a rules DataFrame whose
  row count is checked first): the rules become one ``CASE parameter_name``
  expression, evaluated inside whole-stage codegen with no join, and the rule
  names become a pushed ``IN`` filter on the scan;
* more rules: they are folded to one row per parameter (and location), see
  ``normal_form``, and joined; Spark broadcasts the folded rules if they are
  small, else both sides shuffle and AQE splits a skewed parameter. A record
  meets one row however many rules its parameter has.

Both forms mean the same: a NULL ``low`` or ``high`` is a one-sided limit, a
NULL location holds everywhere, and a location column that the rules lack is an
error.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from linewatch.functions.text import as_number

RULES_SCHEMA = StructType(
    [
        StructField("parameter_name", StringType(), False),
        StructField("work_location_id", IntegerType(), True),
        StructField("work_location_name", StringType(), True),
        StructField("low", DoubleType(), True),
        StructField("high", DoubleType(), True),
    ]
)
_LOCATION_FIELD = {"work_location_id": 1, "work_location_name": 2}

# Rule sets up to this size are compiled into an expression.
MAX_INLINE_RULES = 500

Rules = DataFrame | Sequence[Sequence]


def normalize_rules(rows: Iterable[Sequence]) -> list[tuple]:
    """Rows as ``(name, location_id, location_name, low, high)``.

    Four-field rows ``(name, location_id, low, high)`` get the location name as
    the zero-padded id (``1`` -> ``'01'``).
    """
    full = []
    for r in rows:
        if len(r) == 4:
            name, loc, low, high = r
            loc_name = None if loc is None else f"{loc:02d}"
        else:
            name, loc, loc_name, low, high = r
        full.append((name, loc, loc_name, *(None if x is None else float(x) for x in (low, high))))
    return full


def rules_frame(spark: SparkSession, rows: Iterable[Sequence]) -> DataFrame:
    """Rules DataFrame (``RULES_SCHEMA``) from rule rows."""
    return spark.createDataFrame(normalize_rules(rows), RULES_SCHEMA)


def _check_location(rules: Rules, location_col: str | None) -> None:
    known = rules.columns if isinstance(rules, DataFrame) else _LOCATION_FIELD
    if location_col is not None and location_col not in known:
        raise ValueError(f"the rules have no column {location_col}")


def inline_rules(rules: Rules, max_rules: int | None = MAX_INLINE_RULES, location_col: str | None = None) -> list[tuple] | None:
    """The rule rows when there are at most ``max_rules`` of them (None: any number of a list), else None.

    A DataFrame is read with a limit of ``max_rules + 1`` rows, so a large
    rules table is never pulled to the driver. A location column other than the
    two of ``RULES_SCHEMA`` takes the place of ``work_location_id`` in the rows.
    """
    _check_location(rules, location_col)
    if isinstance(rules, DataFrame):
        if max_rules is None:
            max_rules = MAX_INLINE_RULES
        own = location_col is not None and location_col not in _LOCATION_FIELD
        cols = [
            F.col(location_col).alias(f.name) if own and f.name == "work_location_id"
            else (F.col(f.name) if f.name in rules.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in RULES_SCHEMA.fields
        ]
        got = rules.select(*cols).limit(max_rules + 1).collect()
        rows = [tuple(r) for r in got]
    else:
        rows = normalize_rules(rules)
    return rows if max_rules is None or len(rows) <= max_rules else None


def _sql_text(v: str) -> str:
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_value(v) -> str:
    if isinstance(v, float):
        if math.isfinite(v):
            return f"{v!r}D"
        return "CAST('NaN' AS DOUBLE)" if math.isnan(v) else f"CAST('{'-' if v < 0 else ''}Infinity' AS DOUBLE)"
    return str(v) if isinstance(v, int) else _sql_text(v)


def spec_failure(
    rows: Sequence[tuple],
    value_col: str,
    location_col: str | None = None,
    parameter_col: str = "parameter_name",
) -> Column:
    """Column that is true when the row is outside some rule of its parameter.

    NULL (never true) when the value or a needed location is NULL. The value
    is read with ``try_cast(... AS DOUBLE)``, so text values work and
    unreadable text never fails. The rules are compiled into one
    ``CASE parameter WHEN name THEN <ranges> ELSE false END`` expression,
    parsed once, so the check runs inside whole-stage codegen.
    """
    by_name: dict[str, list[tuple]] = {}
    for r in rows:
        by_name.setdefault(r[0], []).append(r)
    if not by_name:
        return F.lit(False)
    idx = _LOCATION_FIELD.get(location_col, 1) if location_col else None
    v = f"TRY_CAST(`{value_col}` AS DOUBLE)"
    branches = []
    for name, rs in by_name.items():
        tests = []
        for r in rs:
            sides = [f"{v} {op} {_sql_value(x)}" for op, x in (("<", r[3]), (">", r[4])) if x is not None]
            outside = f"({' OR '.join(sides) or 'false'})"
            loc = r[idx] if idx is not None else None
            tests.append(outside if loc is None else f"(`{location_col}` = {_sql_value(loc)} AND {outside})")
        branches.append(f"WHEN {_sql_text(name)} THEN ({' OR '.join(tests)})")
    return F.expr(f"CASE `{parameter_col}` {' '.join(branches)} ELSE false END")


def rule_names(rows: Sequence[tuple]) -> list[str]:
    return sorted({r[0] for r in rows})


def normal_form(rules: DataFrame, location_col: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rules folded to one row per key: a value outside any of a key's ranges is outside their intersection.

    Returns a row per parameter with the limits that hold everywhere (NULL if there are none), and (with ``location_col``) a row
    per parameter and location; a location's limits include those that hold everywhere. The folded low is the largest one and
    the high the smallest; NULL sets no limit.
    """
    side = rules.select(
        F.col("parameter_name").alias("_rule_parameter"), F.col("low").cast("double").alias("_rule_low"), F.col("high").cast("double").alias("_rule_high"),
        (F.col(location_col) if location_col else F.lit(None)).alias("_rule_location"),
    ).where(F.col("_rule_parameter").isNotNull())
    general = F.col("_rule_location").isNull()
    everywhere = side.groupBy("_rule_parameter").agg(F.max(F.when(general, F.col("_rule_low"))).alias("_all_low"), F.min(F.when(general, F.col("_rule_high"))).alias("_all_high"))
    if location_col is None:
        return everywhere, None
    located = side.where(~general).groupBy("_rule_parameter", "_rule_location").agg(F.max("_rule_low").alias("_low"), F.min("_rule_high").alias("_high"))
    both = located.join(everywhere, "_rule_parameter")
    return everywhere, both.select(
        F.col("_rule_parameter").alias("_at_parameter"), F.col("_rule_location").alias("_at_location"),
        F.greatest("_low", "_all_low").alias("_at_low"), F.least("_high", "_all_high").alias("_at_high"),
    )


def out_of_spec(
    records: DataFrame,
    rules: Rules,
    value_col: str = "parameter_value_raw",
    location_col: str | None = None,
    parameter_col: str = "parameter_name",
    max_inline_rules: int = MAX_INLINE_RULES,
) -> DataFrame:
    """Rows of ``records`` outside the limits of some rule of their parameter.

    ``value_col`` may be text (read with ``try_cast``) or numeric. With
    ``location_col`` (``work_location_id`` or ``work_location_name``, or another
    column of both the records and a rules table), a rule applies only where the
    record's location equals the rule's; a rule whose location is NULL applies
    everywhere.
    """
    rows = inline_rules(rules, max_inline_rules, location_col)
    if rows is not None:
        return records.where(F.col(parameter_col).isin(rule_names(rows)) & spec_failure(rows, value_col, location_col, parameter_col))
    if not isinstance(rules, DataFrame):
        rules = rules_frame(records.sparkSession, rules)
    # One row per key on the rule side: a record has at most one match in each join, however many rules its parameter has.
    everywhere, located = normal_form(rules, location_col)
    value, columns, rows = as_number(F.col(value_col)), records.columns, records
    outside = (value < F.col("_all_low")) | (value > F.col("_all_high"))  # a NULL limit tests nothing
    if located is not None:
        rows = records.join(located, (F.col(parameter_col) == F.col("_at_parameter")) & (F.col(location_col) == F.col("_at_location")), "left")
        outside = F.when(F.col("_at_parameter").isNull(), outside).otherwise((value < F.col("_at_low")) | (value > F.col("_at_high")))
    return rows.join(everywhere, (F.col(parameter_col) == F.col("_rule_parameter")) & outside, "left_semi").select(*columns)


def out_of_spec_by_location(
    records: DataFrame,
    rules: Rules,
    location_col: str = "work_location_id",
    value_col: str = "parameter_value_num",
    parameter_col: str = "parameter_name",
) -> DataFrame:
    """``out_of_spec`` where each rule holds only at its work location(s)."""
    return out_of_spec(records, rules, value_col=value_col, location_col=location_col, parameter_col=parameter_col)
