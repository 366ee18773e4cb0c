"""DuckDB statements giving the same rows as ``checks/queries.py``, key by key.

Each statement is self-contained: the fixture views are CTEs in front of it
(DuckDB inlines the ones a statement does not read). Bounds and parameters are
the same literals as in ``checks/queries.py`` and ``linewatch/plans/presets.py``.
"""

from __future__ import annotations

VIEWS = """
WITH ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
),
records AS (
  SELECT user_id AS product_serial, event_type AS station_name,
         'param_' || CAST(k % 17 AS VARCHAR) AS parameter_name,
         CAST(k % 3 AS INTEGER) AS parameter_id,
         CAST(1 + k % 2 AS INTEGER) AS work_location_id,
         '0' || CAST(1 + k % 2 AS VARCHAR) AS work_location_name,
         CASE WHEN k % 5 = 0 THEN 'NOK' ELSE 'OK' END AS overall_process_status,
         CASE WHEN k % 5 = 0 THEN 'FAIL' ELSE 'PASS' END AS result_status,
         CASE WHEN k % 25 = 24 THEN 'PT' || CAST(k AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS parameter_value_raw,
         value AS parameter_value_num, ts AS recorded_at
  FROM ev
),
alarms AS (
  SELECT 'LINE1-' || event_type AS alarm_source, ts AS activated_at,
         CASE WHEN k % 7 = 0 THEN NULL ELSE ts + to_minutes(CAST(k AS INTEGER)) END AS cleared_at,
         CASE k % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS alarm_priority,
         CASE k % 3 WHEN 0 THEN 'Assembly error on Task[301] step'
                    WHEN 1 THEN 'Gripper at work pos Key [' || CAST(k % 10 AS VARCHAR) || ']'
                    ELSE 'Door open' END AS alarm_description
  FROM ev
),
jobs AS (
  SELECT o_custkey AS product_serial, o_orderpriority AS station_name,
         'loc_' || CAST(o_orderkey % 4 AS VARCHAR) AS work_location_desc,
         CASE WHEN o_orderstatus = 'F' THEN 'OK' WHEN o_orderstatus = 'P' THEN 'NOK' ELSE 'OPEN' END AS job_status,
         o_orderdate AS started_at
  FROM orders
),
child_records AS (
  SELECT p_partkey AS product_serial, p_type AS station_name, 'Nest' AS parameter_name FROM part
),
genealogy AS (
  SELECT l_orderkey AS product_serial, l_partkey AS scanned_child_serial, l_shipdate AS consumed_at FROM lineitem
),
failures AS (
  SELECT o_orderkey AS product_serial, o_orderpriority AS station_name,
         CASE WHEN o_orderstatus = 'F' THEN 'NOK' ELSE 'OK' END AS overall_process_status,
         o_orderdate AS recorded_at
  FROM orders
),
batches AS (
  SELECT l_partkey AS product_serial, 'B' || CAST(l_suppkey AS VARCHAR) AS parameter_value_raw FROM lineitem
),
rules AS (
  SELECT * FROM (VALUES
    ('param_0', 1, '01', CAST(5.0 AS DOUBLE), CAST(100.0 AS DOUBLE)),
    ('param_1', 1, '01', CAST(10.0 AS DOUBLE), CAST(50.0 AS DOUBLE)),
    ('param_1', 2, '02', CAST(10.0 AS DOUBLE), CAST(50.0 AS DOUBLE)),
    ('param_2', 2, '02', CAST(1.8 AS DOUBLE), CAST(60.5 AS DOUBLE))
  ) t(parameter_name, work_location_id, work_location_name, low, high)
)
"""

B1 = "TIMESTAMP '2024-01-15 13:00:00'"  # hourly bound
B8 = "TIMESTAMP '2024-01-15 06:00:00'"  # shift-summary bound
FACT = "TIMESTAMP '1998-01-01 00:00:00'"
TZ = "America/Chicago"
LOCAL = f"timezone('{TZ}', timezone('UTC', activated_at))"
ASSEMBLY = "'%Assembly error%Task[301]%'"
GRIPPER = "'%Gripper%work%'"
TAG = "trim(split_part(alarm_description, 'Key', 2), ' []')"


def _oos(src: str, value: str, location: bool = False) -> str:
    """Rows of ``src`` outside some rule: the same meaning as an OR chain of ranges."""
    loc = " AND (r.work_location_id IS NULL OR r.work_location_id = s.work_location_id)" if location else ""
    v = f"TRY_CAST(s.{value} AS DOUBLE)"
    return (
        f"SELECT * FROM {src} s WHERE EXISTS (SELECT 1 FROM rules r WHERE r.parameter_name = s.parameter_name{loc} "
        f"AND ({v} < r.low OR {v} > r.high))"
    )


def _oos_name(src: str, value: str) -> str:
    v = f"TRY_CAST(s.{value} AS DOUBLE)"
    return (
        f"SELECT * FROM {src} s WHERE EXISTS (SELECT 1 FROM rules r WHERE r.parameter_name = s.parameter_name "
        f"AND (r.work_location_name IS NULL OR r.work_location_name = s.work_location_name) AND ({v} < r.low OR {v} > r.high))"
    )


def _alarm_scope(bound: str, source_like: str) -> str:
    return (
        f"SELECT * FROM alarms WHERE {LOCAL} > {bound} AND alarm_source ILIKE '{source_like}' "
        "AND alarm_priority IN ('high', 'critical')"
    )


def _counts(bound: str) -> str:
    """The seven count checks of the fixture plan, with the label columns they produce."""
    scope50 = _alarm_scope(bound, "%LINE1-%")
    scope70 = _alarm_scope(bound, "%LINE1-click%")
    return f"""
  c1 AS (SELECT CAST(count(DISTINCT product_serial) AS BIGINT) AS fail_count, station_name, work_location_desc AS parameter_name
         FROM jobs WHERE started_at > {FACT} AND station_name = '2-HIGH' AND job_status != 'OK'
         GROUP BY station_name, work_location_desc),
  c2 AS (SELECT CAST(count(DISTINCT product_serial) AS BIGINT) AS fail_count, station_name, parameter_name
         FROM records WHERE recorded_at > {bound} AND station_name ILIKE '%i%' AND parameter_name = 'param_5'
           AND parameter_id = 2 AND overall_process_status = 'NOK'
         GROUP BY station_name, parameter_name),
  a50 AS ({scope50}),
  d50 AS (SELECT *, LAG(cleared_at) OVER (PARTITION BY alarm_source ORDER BY activated_at, cleared_at NULLS FIRST, alarm_description) AS prev_cleared_at FROM a50),
  c3 AS (SELECT CAST(count(*) AS BIGINT) AS fail_count, 'S50' AS station_name, 'Check plate fails' AS parameter_name
         FROM d50 WHERE (activated_at > prev_cleared_at + INTERVAL '30 seconds' OR prev_cleared_at IS NULL)
           AND alarm_description ILIKE {ASSEMBLY}
         UNION ALL
         SELECT CAST(count(*) AS BIGINT) AS fail_count, 'S50' AS station_name, {TAG} AS parameter_name
         FROM a50 WHERE alarm_description ILIKE {GRIPPER} GROUP BY {TAG}),
  c4 AS (SELECT CAST(count(*) AS BIGINT) AS fail_count, 'S70' AS station_name, 'Assembly fails' AS alarm_description
         FROM ({scope70}) x WHERE alarm_description ILIKE '%Assembly error%' GROUP BY 2),
  c5 AS (SELECT CAST(count(DISTINCT product_serial) AS BIGINT) AS fail_count, station_name, parameter_name
         FROM ({_oos(f"(SELECT * FROM records WHERE recorded_at > {bound} AND station_name = 'purchase')", "parameter_value_raw")}) x
         GROUP BY station_name, parameter_name),
  c6 AS (SELECT CAST(count(DISTINCT product_serial) AS BIGINT) AS fail_count, station_name, parameter_name
         FROM records WHERE recorded_at > {bound} AND station_name = 'error' AND overall_process_status = 'NOK'
         GROUP BY station_name, parameter_name),
  c7 AS (SELECT CAST(count(DISTINCT product_serial) AS BIGINT) AS fail_count, station_name, parameter_name
         FROM ({_oos(f"(SELECT * FROM records WHERE recorded_at > {bound} AND station_name = 'view' AND overall_process_status = 'NOK')", "parameter_value_num", True)}) x
         GROUP BY station_name, parameter_name),
  combined AS (
    SELECT fail_count, station_name, parameter_name, CAST(NULL AS VARCHAR) AS alarm_description FROM c1
    UNION ALL SELECT fail_count, station_name, parameter_name, NULL FROM c2
    UNION ALL SELECT fail_count, station_name, parameter_name, NULL FROM c3
    UNION ALL SELECT fail_count, station_name, NULL, alarm_description FROM c4
    UNION ALL SELECT fail_count, station_name, parameter_name, NULL FROM c5
    UNION ALL SELECT fail_count, station_name, parameter_name, NULL FROM c6
    UNION ALL SELECT fail_count, station_name, parameter_name, NULL FROM c7),
  merged AS (SELECT fail_count, station_name, coalesce(alarm_description, parameter_name) AS parameter_name
             FROM combined WHERE fail_count > 0),
  exact AS (SELECT CAST(count(DISTINCT product_serial) AS BIGINT) AS fail_count, station_name
            FROM ({_oos_name(f"(SELECT * FROM records WHERE recorded_at > {bound} AND station_name = 'click' AND overall_process_status = 'NOK')", "parameter_value_num")}) x
            GROUP BY station_name),
  totals AS (SELECT station_name, CAST(sum(fail_count) AS BIGINT) AS fail_count FROM merged
             WHERE station_name IS NOT NULL GROUP BY station_name),
  overridden AS (SELECT t.station_name, CAST(coalesce(e.fail_count, t.fail_count, 0) AS BIGINT) AS fail_count
                 FROM totals t LEFT JOIN exact e ON t.station_name = e.station_name),
  pareto AS (SELECT station_name, fail_count FROM overridden WHERE fail_count > 0)"""


def _trace(fail_where: str, origin_like: str) -> str:
    return f"""
    SELECT CAST(count(DISTINCT g.product_serial) AS BIGINT) AS fail_count, f.station_name, c.station_name AS origin_station
    FROM child_records c
    JOIN genealogy g ON c.product_serial = g.scanned_child_serial
    JOIN failures f ON g.product_serial = f.product_serial
    WHERE f.recorded_at > {FACT} AND f.overall_process_status = 'NOK' AND {fail_where}
      AND c.station_name LIKE '{origin_like}' AND c.parameter_name = 'Nest'
    GROUP BY f.station_name, c.station_name"""


ORIGIN = f"""
  origin AS ({_trace("f.station_name ILIKE '%URGENT%'", "%L%")}
    UNION ALL {_trace("f.station_name ILIKE '%HIGH%'", "S%")}
    UNION ALL {_trace("f.station_name = '3-MEDIUM'", "P%")})"""


def _position(*ties: str) -> str:
    """Rank in a report: most failures first, then the ties ascending."""
    order = ", ".join(["fail_count DESC", *(f"{t} ASC NULLS LAST" for t in ties)])
    return f"CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS position"


BY_LABEL = _position("station_name", "parameter_name")
BY_STATION = _position("station_name")
BY_ORIGIN = _position("TRY_CAST(station_name AS INTEGER)", "station_name", "origin_station")


def _sections(bound: str) -> str:
    return VIEWS + "," + _counts(bound) + "," + ORIGIN + f""",
  sections AS (
    SELECT 'parameter' AS section, {BY_LABEL}, fail_count, station_name, parameter_name, CAST(NULL AS VARCHAR) AS origin_station FROM merged
    UNION ALL SELECT 'pareto', {BY_STATION}, fail_count, station_name, NULL, NULL FROM pareto
    UNION ALL SELECT 'origin', {BY_ORIGIN}, fail_count, station_name, NULL, origin_station FROM origin)
"""


DATED = """,
  dated AS (SELECT product_serial, station_name, overall_process_status, 'param_' || CAST(product_serial % 3 AS VARCHAR) AS parameter_name,
                   CAST(product_serial % 120 AS VARCHAR) AS parameter_value_raw,
                   TIMESTAMP '2024-01-15 00:30:00' + to_hours(CAST(product_serial % 16 AS INTEGER)) AS recorded_at FROM failures)"""


def _dated_origin(bound: str, fail_where: str, origin_like: str) -> str:
    return f"""SELECT {BY_ORIGIN}, * FROM (
    SELECT CAST(count(DISTINCT g.product_serial) AS BIGINT) AS fail_count, f.station_name, c.station_name AS origin_station
    FROM child_records c
    JOIN genealogy g ON c.product_serial = g.scanned_child_serial
    JOIN dated f ON g.product_serial = f.product_serial
    WHERE f.recorded_at > {bound} AND {fail_where} AND c.station_name LIKE '{origin_like}' AND c.parameter_name = 'Nest'
    GROUP BY f.station_name, c.station_name) t"""


def _one_sided() -> str:
    v = "parameter_value_num"
    return (f"(parameter_name = 'param_0' AND {v} < 20.0 OR parameter_name = 'param_1' AND {v} > 40.0 "
            f"OR parameter_name = 'param_2' AND work_location_id = 1 AND {v} < 5.0)")


SQL: dict[str, str] = {
    "recent_records": VIEWS + f"""
SELECT product_serial, station_name, parameter_name, parameter_id, overall_process_status, recorded_at,
       TRY_CAST(parameter_value_raw AS DOUBLE) AS value_num
FROM records WHERE recorded_at > {B1}""",
    "recent_alarms_local": VIEWS + f"""
SELECT alarm_source, activated_at, {LOCAL} AS activated_local FROM alarms WHERE {LOCAL} > {B1}""",
    "alarm_pattern_filter": VIEWS + f"""
SELECT alarm_source, activated_at, alarm_description FROM alarms WHERE alarm_description ILIKE {ASSEMBLY}""",
    "out_of_spec_rows": VIEWS + f"""
SELECT product_serial, station_name, parameter_name, recorded_at, TRY_CAST(parameter_value_raw AS DOUBLE) AS value_num
FROM ({_oos("records", "parameter_value_raw")}) x""",
    "out_of_spec_by_location": VIEWS + f"""
SELECT product_serial, station_name, parameter_name, work_location_id, recorded_at, parameter_value_num
FROM ({_oos("records", "parameter_value_num", True)}) x""",
    "one_sided_limits": VIEWS + f"""
SELECT form, product_serial, station_name, parameter_name, recorded_at
FROM records, (VALUES ('compiled'), ('joined')) f(form) WHERE {_one_sided()}""",
    "positive_counts": VIEWS + """,
  t AS (
    SELECT CAST(count(*) AS BIGINT) AS fail_count, 'LINE1-view' AS station_name, 'door' AS parameter_name
    FROM alarms WHERE alarm_source = 'LINE1-view' AND alarm_description ILIKE 'Door open'
    UNION ALL
    SELECT CAST(count(*) AS BIGINT), 'LINE1-click', 'missing'
    FROM alarms WHERE alarm_source = 'LINE1-click' AND alarm_description ILIKE '%no such alarm%'
    UNION ALL
    SELECT CAST(count(*) AS BIGINT), 'LINE1-error', 'assembly'
    FROM alarms WHERE alarm_source = 'LINE1-error' AND alarm_description ILIKE '%Assembly error%')
SELECT * FROM t WHERE fail_count > 0""",
    "shift_end_rows": f"""
SELECT event_id, ts, timezone('{TZ}', timezone('UTC', ts)) AS local_ts FROM events
WHERE CAST(hour(timezone('{TZ}', timezone('UTC', ts))) AS INTEGER) IN (5, 15)""",
    "alarm_tag_extract": VIEWS + f"""
SELECT alarm_source, activated_at, alarm_description, {TAG} AS tag FROM alarms""",
    "label_coalesce": VIEWS + f""",
  c4 AS (SELECT CAST(count(*) AS BIGINT) AS fail_count, 'S70' AS station_name, 'Assembly fails' AS alarm_description
         FROM ({_alarm_scope(B1, "%LINE1-click%")}) x WHERE alarm_description ILIKE '%Assembly error%' GROUP BY 2),
  c6 AS (SELECT CAST(count(DISTINCT product_serial) AS BIGINT) AS fail_count, station_name, parameter_name
         FROM records WHERE recorded_at > {B1} AND station_name = 'error' AND overall_process_status = 'NOK'
         GROUP BY station_name, parameter_name)
SELECT fail_count, station_name, alarm_description AS parameter_name FROM c4
UNION ALL SELECT fail_count, station_name, parameter_name FROM c6""",
    "spool_code_extract": VIEWS + """,
  s AS (SELECT product_serial, 'PT' || CAST(product_serial AS VARCHAR) || '-C' || parameter_value_raw AS parameter_value_raw FROM batches)
SELECT product_serial, parameter_value_raw,
       substring(parameter_value_raw, strpos(parameter_value_raw, 'C') + 1, 8) AS spool_code FROM s""",
    "pair_label_extract": VIEWS + """,
  p AS (SELECT product_serial, 'S' || lpad(CAST(product_serial AS VARCHAR), 7, '0') || '& T' || lpad(CAST(product_serial AS VARCHAR), 7, '0') AS pair FROM batches)
SELECT product_serial, pair, left(pair, 5) || ' & ' || substring(pair, strpos(pair, '&') + 2, 5) AS label FROM p""",
    "hour_text_extract": VIEWS + """
SELECT product_serial, recorded_at, strftime(recorded_at, '%Y-%m-%d %H:00') AS hour FROM records""",
    "trace_existing": VIEWS + f"""
SELECT CAST(count(DISTINCT g.product_serial) AS BIGINT) AS fail_count, f.station_name, c.station_name AS origin_station
FROM child_records c
JOIN genealogy g ON c.product_serial = g.scanned_child_serial
JOIN failures f ON g.product_serial = f.product_serial
WHERE f.recorded_at > {FACT} AND f.overall_process_status = 'NOK'
  AND g.product_serial IN (SELECT product_serial FROM jobs WHERE job_status = 'OPEN')
GROUP BY f.station_name, c.station_name""",
    "hourly_origin_window": VIEWS + DATED + f"""
SELECT fail_count, station_name, origin_station, position, 1 AS hours
FROM ({_dated_origin(B1, "f.station_name ILIKE '%HIGH%' AND f.overall_process_status = 'NOK'", "S%")}) a
UNION ALL
SELECT fail_count, station_name, origin_station, position, 8
FROM ({_dated_origin(B8, "f.station_name ILIKE '%HIGH%' AND f.overall_process_status = 'NOK'", "S%")}) b""",
    "trace_out_of_spec": VIEWS + DATED + f"""
SELECT fail_count, station_name, origin_station, position FROM ({_dated_origin(
    B8,
    "f.station_name = '2-HIGH' AND EXISTS (SELECT 1 FROM rules r WHERE r.parameter_name = f.parameter_name AND "
    "(TRY_CAST(f.parameter_value_raw AS DOUBLE) < r.low OR TRY_CAST(f.parameter_value_raw AS DOUBLE) > r.high))",
    "P%",
)}) a""",
    "report_json": _sections(B1) + """
SELECT 'parameter' AS section, position, to_json({'position': position, 'fail_count': fail_count, 'station_name': station_name, 'parameter_name': parameter_name}) ::VARCHAR AS line
FROM sections WHERE section = 'parameter'
UNION ALL
SELECT 'pareto', position, to_json({'position': position, 'station_name': station_name, 'fail_count': fail_count})::VARCHAR FROM sections WHERE section = 'pareto'
UNION ALL
SELECT 'origin', position, to_json({'position': position, 'fail_count': fail_count, 'station_name': station_name, 'origin_station': origin_station})::VARCHAR
FROM sections WHERE section = 'origin'""",
    "trace_origin": VIEWS + f"""
SELECT CAST(count(DISTINCT g.product_serial) AS BIGINT) AS fail_count, f.station_name, c.station_name AS origin_station
FROM child_records c
JOIN genealogy g ON c.product_serial = g.scanned_child_serial
JOIN failures f ON g.product_serial = f.product_serial
WHERE f.recorded_at > {FACT} AND f.overall_process_status = 'NOK'
GROUP BY f.station_name, c.station_name""",
    "override_station_totals": VIEWS + "," + _counts(B1) + """
SELECT station_name, fail_count FROM overridden""",
    "job_fail_counts": VIEWS + f"""
SELECT CAST(count(DISTINCT product_serial) AS BIGINT) AS fail_count, station_name, work_location_desc AS parameter_name
FROM jobs WHERE started_at > {FACT} AND station_name = '2-HIGH' AND job_status != 'OK'
GROUP BY station_name, work_location_desc""",
    "param_fail_counts": VIEWS + f"""
SELECT CAST(count(DISTINCT product_serial) AS BIGINT) AS fail_count, station_name, parameter_name
FROM records WHERE recorded_at > {B1} AND station_name ILIKE '%i%' AND parameter_name = 'param_5'
  AND parameter_id = 2 AND overall_process_status = 'NOK'
GROUP BY station_name, parameter_name""",
    "station_nok_counts": VIEWS + f"""
SELECT CAST(count(DISTINCT product_serial) AS BIGINT) AS fail_count, station_name, parameter_name
FROM records WHERE recorded_at > {B1} AND overall_process_status = 'NOK'
GROUP BY station_name, parameter_name""",
    "out_of_spec_counts": VIEWS + f"""
SELECT CAST(count(DISTINCT product_serial) AS BIGINT) AS fail_count, station_name, parameter_name
FROM ({_oos(f"(SELECT * FROM records WHERE recorded_at > {B1})", "parameter_value_raw")}) x
GROUP BY station_name, parameter_name""",
    "out_of_spec_location_counts": VIEWS + f"""
SELECT CAST(count(DISTINCT product_serial) AS BIGINT) AS fail_count, station_name, parameter_name
FROM ({_oos(f"(SELECT * FROM records WHERE recorded_at > {B1} AND overall_process_status = 'NOK')", "parameter_value_num", True)}) x
GROUP BY station_name, parameter_name""",
    "station_unique_fails": VIEWS + f"""
SELECT CAST(count(DISTINCT product_serial) AS BIGINT) AS fail_count, station_name
FROM ({_oos_name(f"(SELECT * FROM records WHERE recorded_at > {B1} AND overall_process_status = 'NOK')", "parameter_value_num")}) x
GROUP BY station_name""",
    "alarm_count": VIEWS + f"""
SELECT CAST(count(*) AS BIGINT) AS fail_count, 'S70' AS station_name, 'Assembly fails' AS alarm_description
FROM ({_alarm_scope(B1, "%LINE1-click%")}) x WHERE alarm_description ILIKE '%Assembly error%' GROUP BY 2""",
    "alarm_tag_counts": VIEWS + f"""
SELECT CAST(count(*) AS BIGINT) AS fail_count, 'S50' AS station_name, {TAG} AS parameter_name
FROM alarms WHERE alarm_description ILIKE {GRIPPER} GROUP BY {TAG}""",
    "station_pareto": VIEWS + "," + _counts(B1) + """
SELECT station_name, fail_count FROM totals""",
    "distinct_events": VIEWS + f"""
SELECT DISTINCT product_serial, station_name, parameter_name, recorded_at
FROM ({_oos(f"(SELECT * FROM records WHERE recorded_at > {B1})", "parameter_value_raw")}) x""",
    "alarm_debounce": VIEWS + f""",
  a AS (SELECT * FROM alarms WHERE alarm_priority IN ('high', 'critical')),
  d AS (SELECT *, LAG(cleared_at) OVER (PARTITION BY alarm_source ORDER BY activated_at, cleared_at NULLS FIRST, alarm_description) AS prev_cleared_at FROM a)
SELECT alarm_source, activated_at, cleared_at, alarm_priority, alarm_description, prev_cleared_at FROM d
WHERE (activated_at > prev_cleared_at + INTERVAL '30 seconds' OR prev_cleared_at IS NULL)
  AND alarm_description ILIKE {ASSEMBLY}""",
    "origin_report": VIEWS + f""",
  traced AS (
    SELECT CAST(count(DISTINCT g.product_serial) AS BIGINT) AS fail_count,
           CAST(6 + 2 * CAST(substring(f.station_name, 1, 1) AS INTEGER) AS VARCHAR) AS station_name, c.station_name AS origin_station
    FROM child_records c
    JOIN genealogy g ON c.product_serial = g.scanned_child_serial
    JOIN failures f ON g.product_serial = f.product_serial
    WHERE f.recorded_at > {FACT} AND f.overall_process_status = 'NOK'
    GROUP BY f.station_name, c.station_name)
SELECT fail_count, station_name, origin_station, {BY_ORIGIN} FROM traced""",
    "alarm_report": VIEWS + f""",
  a50 AS ({_alarm_scope(B1, "%LINE1-%")}),
  d50 AS (SELECT *, LAG(cleared_at) OVER (PARTITION BY alarm_source ORDER BY activated_at, cleared_at NULLS FIRST, alarm_description) AS prev_cleared_at FROM a50)
SELECT CAST(count(*) AS BIGINT) AS fail_count, 'S50' AS station_name, 'Check plate fails' AS parameter_name
FROM d50 WHERE (activated_at > prev_cleared_at + INTERVAL '30 seconds' OR prev_cleared_at IS NULL)
  AND alarm_description ILIKE {ASSEMBLY}
UNION ALL
SELECT CAST(count(*) AS BIGINT), 'S50', {TAG} FROM a50 WHERE alarm_description ILIKE {GRIPPER} GROUP BY {TAG}""",
    "combined_report": VIEWS + "," + _counts(B1) + """
SELECT fail_count, station_name, parameter_name, alarm_description FROM combined""",
    "hourly_report": VIEWS + "," + _counts(B1) + """
SELECT fail_count, station_name, parameter_name, """ + BY_LABEL + " FROM merged",
    "hourly_pareto": VIEWS + "," + _counts(B1) + """
SELECT station_name, fail_count, """ + BY_STATION + " FROM pareto",
    "hourly_origin": VIEWS + "," + ORIGIN + """
SELECT fail_count, station_name, origin_station, """ + BY_ORIGIN + " FROM origin",
    "hourly_origin_filtered": VIEWS + "," + ORIGIN + """
SELECT fail_count, station_name, origin_station, """ + BY_ORIGIN + " FROM origin",
    "hourly_origin_kept": VIEWS + "," + ORIGIN + """
SELECT fail_count, station_name, origin_station, """ + BY_ORIGIN + " FROM origin",
    "shift_summary": _sections(B8) + """
SELECT section, position, fail_count, station_name, parameter_name, origin_station FROM sections""",
    "fail_counts_stream": VIEWS + """,
  nok AS (SELECT *, time_bucket(INTERVAL '1 hour', recorded_at) AS window_start FROM records WHERE overall_process_status = 'NOK'),
  counted AS (SELECT window_start, window_start + INTERVAL '1 hour' AS window_end, station_name, parameter_name,
                     CAST(count(DISTINCT product_serial) AS BIGINT) AS fail_count
              FROM nok GROUP BY window_start, station_name, parameter_name)
SELECT * FROM counted
WHERE window_end <= (SELECT max(recorded_at) FROM nok) - INTERVAL '10 minutes'""",
}

_SECTION = "SELECT section, position, fail_count, station_name, parameter_name, origin_station"
SQL |= {
    "alarm_debounce_storm": SQL["alarm_debounce"],
    "shift_summary_states": SQL["shift_summary"],
    "fail_counts_corrected": VIEWS + """
SELECT time_bucket(INTERVAL '1 hour', recorded_at) AS window_start, time_bucket(INTERVAL '1 hour', recorded_at) + INTERVAL '1 hour' AS window_end,
       station_name, parameter_name, CAST(count(DISTINCT product_serial) AS BIGINT) AS fail_count
FROM records WHERE overall_process_status = 'NOK' GROUP BY ALL""",
    "shift_end_run": f"{_SECTION}, 'hourly' AS report FROM ({_sections(B1)} {_SECTION} FROM sections) h "
    f"UNION ALL {_SECTION}, 'shift' AS report FROM ({_sections(B8)} {_SECTION} FROM sections) s",
}
