"""Run the monitoring job once from the command line.

    python -m linewatch --records mes.parameter_records --alarms scada.alarms \
        --jobs mes.work_location_jobs --genealogy mes.genealogy \
        --line LINE01 --shop PLANT1 --out /shared/reports/run=2024-01-15T14

The session is the one that the submit command sets up: master, shuffle partitions
and checkpoint folder are its settings. Tables are catalog names or Parquet paths. ``--as-of`` defaults to now (UTC);
the clock is read here, never inside an operator. Schedule it hourly with the
scheduler of your choice.
"""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from linewatch.defaults import LINE_TZ
from linewatch.operators.origins import OriginStore
from linewatch.plans.checks import LineTables
from linewatch.plans.job import refresh_origins, refresh_states, run_report, write_run
from linewatch.plans.presets import line_plan
from linewatch.plans.states import HourStates
from linewatch.session import size_shuffles
from linewatch.sources.tables import load_table


def _partitions(text: str | None) -> dict[str, str]:
    if not text:
        return {}
    return dict(item.split("=", 1) for item in text.split(","))


def main(argv: list[str] | None = None) -> list[str]:
    p = argparse.ArgumentParser(prog="linewatch", description=__doc__.split("\n\n")[0])
    p.add_argument("--records", required=True)
    p.add_argument("--alarms", required=True)
    p.add_argument("--jobs", required=True)
    p.add_argument("--genealogy", required=True)
    p.add_argument("--line", required=True, help="line name, e.g. LINE01")
    p.add_argument("--line-like", default=None, help="pattern of line names to count instead of the one line")
    p.add_argument("--shop", default=None, help="plant/shop name filter")
    p.add_argument("--tz", default=LINE_TZ, help="zone of the line's wall clock")
    p.add_argument("--as-of", default=None, help="run instant in UTC, ISO format (default: now)")
    p.add_argument("--hours", type=int, default=1)
    p.add_argument("--force-shift", action="store_true", help="also build the shift summary")
    p.add_argument("--exact-window", action="store_true", help="count rows only up to the last full hour")
    p.add_argument("--date-partitions", default=None, help="e.g. records=recorded_date,alarms=activated_date")
    p.add_argument("--origins", default=None, help="folder of the kept origin table; traces read it in place of the records' history")
    p.add_argument("--origin-days", type=int, default=2, help="days up to the run's that are brought into it before the report (0: none)")
    p.add_argument("--origin-buckets", type=int, default=64, help="its hash buckets per day and station, a power of two")
    p.add_argument("--states", default=None, help="folder of the kept hour states; the shift summary merges them in place of reading its hours again")
    p.add_argument("--out", required=True)
    p.add_argument("--format", default="json")
    p.add_argument("--as-lines", action="store_true", help="one JSON text line per report row")
    p.add_argument("--explain", action="store_true", help="print the physical plans instead of writing")
    p.add_argument("--shuffle-gb", type=float, default=None, help="expected largest shuffle, to size shuffle partitions")
    args = p.parse_args(argv)

    as_of = datetime.fromisoformat(args.as_of) if args.as_of else datetime.now(timezone.utc).replace(tzinfo=None)
    spark = SparkSession.builder.appName("linewatch").getOrCreate()
    if args.shuffle_gb:
        size_shuffles(spark, int(args.shuffle_gb * 1024**3))
    tables = LineTables(
        records=load_table(spark, args.records, pin=True),
        alarms=load_table(spark, args.alarms, pin=True),
        jobs=load_table(spark, args.jobs, pin=True),
        genealogy=load_table(spark, args.genealogy, pin=True),
        date_partitions=_partitions(args.date_partitions),
    )
    plan, shift_plan = (line_plan(args.line, shop=args.shop, shift=shift, local_tz=args.tz, line_like=args.line_like) for shift in (False, True))
    if args.states and args.exact_window:
        p.error("--states does not go with --exact-window")
    states = None
    if args.states:
        states = HourStates(args.states)
        if not args.explain:
            refresh_states(states, tables, plan, as_of, shift_plan)
    store = None
    if args.origins:
        # the plan's origin tests read the line and, with --shop, the shop
        extra = "line_name string" + (", shop_name string" if args.shop else "")
        store = OriginStore(args.origins, args.origin_buckets, extra)
        if args.origin_days and not args.explain:
            refresh_origins(store, tables, plan, as_of, args.origin_days)
    run = run_report(
        tables if store is None else store.tables(tables),
        plan,
        as_of,
        shift_plan=shift_plan,
        hours=args.hours,
        force_shift=args.force_shift,
        exact_window=args.exact_window,
        states=states,
    )
    if args.explain:
        run.sections.explain("formatted")
        return []
    paths = write_run(run, args.out, fmt=args.format, as_lines=args.as_lines)
    for path in paths:
        print(path)
    return paths


if __name__ == "__main__":
    main()
