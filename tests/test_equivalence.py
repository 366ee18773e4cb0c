"""Equivalence tests: each optimized form against a plain one on random rows."""

import random
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import alarms, record, records
from linewatch.functions.time import coarse_source_bound
from linewatch.operators import alarms as al
from linewatch.operators.limits import normalize_rules, out_of_spec, rules_frame
from linewatch.plans import reports as rp
from linewatch.plans.presets import FIXTURE_AS_OF, fixture_plan
from linewatch.sources import fixtures as fx
from linewatch.plans.checks import LineTables

SF = "/root/testdata/sf0.001"


def _random_rules(rng):
    rules = []
    for name in ["a", "b", "c", "it's"]:
        for _ in range(rng.randint(1, 3)):
            low = rng.uniform(-10, 10)
            rules.append((name, rng.choice([None, 1, 2]), low, low + rng.uniform(0, 10)))
    return rules


def _python_fails(rows, rules, location):
    out = []
    for r in rows:
        serial, _, param, _, loc, _, _, _, raw, _, _ = r
        try:
            v = float(raw) if raw is not None else None
        except ValueError:
            v = None
        hit = False
        for name, rloc, low, high in rules:
            if name != param or v is None:
                continue
            if location and rloc is not None and rloc != loc:
                continue
            if v < low or v > high:
                hit = True
        if hit:
            out.append(serial)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("location", [None, "work_location_id"])
def test_rules_forms_agree(spark, seed, location):
    rng = random.Random(seed)
    rules = _random_rules(rng)
    rows = []
    for i in range(300):
        raw = rng.choice([None, "junk", f"{rng.uniform(-25, 25):.3f}", str(rng.randint(-20, 20))])
        rows.append(record(f"s{i}", param=rng.choice(["a", "b", "c", "it's", "z"]), raw=raw, loc=rng.choice([1, 2, 3, None])))
    df = records(spark, rows)
    expected = _python_fails(rows, rules, location)
    inline = sorted(r.product_serial for r in out_of_spec(df, rules, location_col=location).collect())
    joined = sorted(r.product_serial for r in out_of_spec(df, rules_frame(spark, rules), location_col=location, max_inline_rules=0).collect())
    assert inline == expected
    assert joined == expected


def _python_debounce(rows, gap):
    by_src = {}
    for r in rows:
        by_src.setdefault(r[0], []).append(r)
    kept = []
    for src, rs in by_src.items():
        rs.sort(key=lambda r: r[1])
        prev_end = None
        for i, r in enumerate(rs):
            if i == 0 or prev_end is None or r[1] > prev_end + timedelta(seconds=gap):
                kept.append((src, r[1]))
            prev_end = r[2]
    return sorted(kept)


@pytest.mark.parametrize("seed", [7, 8])
def test_debounce_matches_plain_lag(spark, seed):
    rng = random.Random(seed)
    t0 = datetime(2024, 1, 15, 0, 0)
    rows = []
    for src in ["A", "B", "C"]:
        t = t0
        n = 400 if src == "A" else 40  # one hot source
        for _ in range(n):
            t += timedelta(seconds=rng.randint(1, 400))
            end = None if rng.random() < 0.15 else t + timedelta(seconds=rng.randint(0, 90))
            rows.append((src, t, end, "high", "Assembly error"))
    df = alarms(spark, rows)
    expected = _python_debounce(rows, 30)
    plain = df.withColumn("prev_cleared_at", F.lag("cleared_at").over(Window.partitionBy("alarm_source").orderBy("activated_at")))
    plain = plain.where(F.col("prev_cleared_at").isNull() | (F.col("activated_at") > F.col("prev_cleared_at") + F.expr("INTERVAL 30 SECONDS")))
    assert sorted((r.alarm_source, r.activated_at) for r in plain.collect()) == expected
    for unit in ["hour", "minute"]:
        got = sorted((r.alarm_source, r.activated_at) for r in al.debounce(df, slice_unit=unit).collect())
        assert got == expected, unit


@pytest.mark.parametrize("tz", ["America/Chicago", "Europe/Berlin", "Pacific/Apia", "Asia/Kolkata"])
def test_coarse_bound_is_a_superset(tz):
    rng = random.Random(3)
    zone = ZoneInfo(tz)
    for _ in range(3000):
        utc = datetime(2011, 1, 1) + timedelta(minutes=rng.randint(0, 60 * 24 * 365 * 3))
        local = utc.replace(tzinfo=ZoneInfo("UTC")).astimezone(zone).replace(tzinfo=None)
        bound = local - timedelta(minutes=rng.randint(1, 600))
        # the row passes the exact test, so it must pass the coarse one
        assert utc > coarse_source_bound(bound, "UTC", tz)


def test_fused_report_equals_per_check_frames(spark):
    t = LineTables(
        records=fx.records(spark, SF), alarms=fx.alarms(spark, SF), jobs=fx.jobs(spark, SF), genealogy=fx.genealogy(spark, SF),
        children=fx.child_records(spark, SF), failures=fx.failures(spark, SF),
    )
    plan = fixture_plan()
    as_of = FIXTURE_AS_OF
    bound = rp._bound(as_of, 240)
    fused = sorted(tuple(r) for r in rp.fail_counts(t, plan, as_of, 240).collect())
    single = rp.positive_counts(rp.merge_labels(rp.combine_reports([c.frame(t, bound, plan.local_tz) for c in plan.counts])))
    assert fused == sorted(tuple(r) for r in single.collect())
    fused_origin = sorted(tuple(r) for r in rp.origin_trace_report(t, plan, as_of, 240).drop("position").collect())
    single_origin = rp.combine_reports([c.frame(t, bound, plan.local_tz) for c in plan.traces])
    assert fused_origin == sorted(tuple(r) for r in single_origin.collect())


def test_normalize_rules_pads_location_name():
    assert normalize_rules([("x", 1, 0, 1), ("y", None, 0, 1)]) == [("x", 1, "01", 0.0, 1.0), ("y", None, None, 0.0, 1.0)]


def _or_chain(rules, value, location):
    """The original's form: one OR-ed branch per rule."""
    parts = []
    for name, loc, low, high in rules:
        branch = f"(parameter_name = '{name}' AND ({value} < {low!r} OR {value} > {high!r}))"
        if location and loc is not None:
            branch = f"({branch} AND {location} = {loc})"
        parts.append(branch)
    return " OR ".join(parts)


@pytest.mark.parametrize("rule_set,location,value_col", [
    ("VISION_LIMITS", None, "parameter_value_raw"),
    ("VISION_LIMITS_SHIFT", None, "parameter_value_raw"),
    ("PIN_TRACE_LIMITS", None, "parameter_value_raw"),
    ("ELECTRICAL_LIMITS", "work_location_id", "parameter_value_num"),
])
def test_line_rule_sets_equal_or_chain(spark, rule_set, location, value_col):
    from linewatch.plans import rules as line_rules

    rules = getattr(line_rules, rule_set)
    rng = random.Random(11)
    rows = []
    for i in range(600):
        name, _, low, high = rng.choice(rules)
        v = rng.choice([low, high, low - 0.01, high + 0.01, (low + high) / 2, rng.uniform(low - 10, high + 10)])
        rows.append(record(f"s{i}", param=name, value=v, loc=rng.choice([1, 2])))
    df = records(spark, rows)
    value = f"TRY_CAST({value_col} AS DOUBLE)"
    expected = sorted(r.product_serial for r in df.where(F.expr(_or_chain(rules, value, location))).collect())
    inline = sorted(r.product_serial for r in out_of_spec(df, rules, value_col=value_col, location_col=location).collect())
    joined = sorted(r.product_serial for r in out_of_spec(df, rules_frame(spark, rules), value_col=value_col, location_col=location, max_inline_rules=0).collect())
    assert inline == expected
    assert joined == expected
    assert 0 < len(expected) < len(rows)


def test_text_helpers_match_python(spark):
    from linewatch.functions import bracket_tag, spool_code

    rng = random.Random(5)
    alphabet = ["Key", "key", "[", "]", " ", "C", "c", "a", "7", "&", "Gripper "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", bracket_tag("t").alias("tag"), spool_code("t").alias("code")
    ).collect()
    for r in rows:
        t = texts[r.i]
        parts = t.split("Key")
        assert r.tag == (parts[1].strip(" []") if len(parts) > 1 else ""), t
        start = t.find("C") + 1  # 0 when absent: from the start
        assert r.code == t[start:start + 8], t


@pytest.mark.parametrize("tz", ["America/Chicago", "Europe/Berlin"])
def test_since_local_matches_zoneinfo_across_dst(spark, tz):
    from linewatch.functions.time import since_local

    rng = random.Random(9)
    zone = ZoneInfo(tz)
    changes = [datetime(2024, 3, 10, 8, 0), datetime(2024, 11, 3, 7, 0), datetime(2024, 3, 31, 1, 0), datetime(2024, 10, 27, 1, 0)]
    instants = [c + timedelta(minutes=rng.randint(-300, 300)) for c in changes for _ in range(150)]
    bounds = [c + timedelta(minutes=rng.randint(-300, 300)) for c in changes for _ in range(3)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(instants)], "i int, activated_at timestamp_ntz")
    for b in bounds:
        got = sorted(r.i for r in since_local(df, "activated_at", b, "UTC", tz).collect())
        local = [t.replace(tzinfo=ZoneInfo("UTC")).astimezone(zone).replace(tzinfo=None) for t in instants]
        assert got == [i for i, lt in enumerate(local) if lt > b], b


@pytest.mark.parametrize("seed", [21, 22, 23])
def test_fused_counts_random_plans(spark, seed):
    """Random records and random plans: the one-pass report equals per-check plans and a pandas brute force."""
    from linewatch.plans.checks import LinePlan, NokCheck, ParamCheck, SpecCheck

    rng = random.Random(seed)
    stations, params = ["S1", "S2", "S3"], ["a", "b", "c"]
    t0 = datetime(2024, 1, 15, 12, 0)
    rows = [
        record(f"u{rng.randint(0, 40)}", param=rng.choice(params), value=rng.uniform(0, 10), station=rng.choice(stations),
               status=rng.choice(["OK", "NOK"]), loc=rng.choice([1, 2]), pid=rng.randint(0, 2),
               ts=t0 + timedelta(minutes=rng.randint(0, 180)))
        for _ in range(400)
    ]
    rules = [(p, rng.choice([None, 1, 2]), 2.0, 8.0) for p in params]
    counts = (
        ParamCheck(parameter=rng.choice(params), station=rng.choice(stations), parameter_id=rng.randint(0, 2)),
        NokCheck(station_like=rng.choice(["S%", "%2"])),
        SpecCheck(rules=rules, station=rng.choice(stations), value_col="parameter_value_num", location_col="work_location_id", status="NOK"),
        SpecCheck(rules=rules, value_col="parameter_value_raw", since=t0 + timedelta(minutes=30)),
    )
    exact = (SpecCheck(rules=rules, station=rng.choice(stations), value_col="parameter_value_num", per_station=True),)
    df = records(spark, rows)
    empty = alarms(spark, [])
    tables = LineTables(records=df, alarms=empty, jobs=df, genealogy=df)
    plan = LinePlan(counts=counts, exact=exact)
    as_of = datetime(2024, 1, 15, 14, 37)
    bound = rp._bound(as_of, 2)
    fused = sorted(tuple(r) for r in rp.fail_counts(tables, plan, as_of, 2).collect())
    single = rp.positive_counts(rp.merge_labels(rp.combine_reports([c.frame(tables, bound, plan.local_tz) for c in counts])))
    assert fused == sorted(tuple(r) for r in single.collect())

    import pandas as pd

    pdf = pd.DataFrame(rows, columns=[f.name for f in df.schema.fields])
    pdf["v_raw"] = pd.to_numeric(pdf["parameter_value_raw"], errors="coerce")

    def outside(r, value, location):
        for name, loc, low, high in rules:
            if name == r.parameter_name and (not location or loc is None or loc == r.work_location_id):
                v = r[value]
                if pd.notna(v) and (v < low or v > high):
                    return True
        return False

    expected = {}
    def add(sel, per_station=False):
        for (st, p), g in sel.groupby(["station_name", "parameter_name"]) if not per_station else []:
            expected[(st, p)] = expected.get((st, p), 0) + g.product_serial.nunique()
    recent = pdf[pdf.recorded_at > bound]
    c0, c1, c2, c3 = counts
    add(recent[(recent.station_name == c0.station) & (recent.parameter_name == c0.parameter) & (recent.parameter_id == c0.parameter_id) & (recent.overall_process_status == "NOK")])
    like = (lambda s: s.startswith("S")) if c1.station_like == "S%" else (lambda s: s.endswith("2"))
    add(recent[recent.station_name.map(like) & (recent.overall_process_status == "NOK")])
    add(recent[(recent.station_name == c2.station) & (recent.overall_process_status == "NOK") & recent.apply(lambda r: outside(r, "parameter_value_num", True), axis=1)])
    late = pdf[pdf.recorded_at > c3.since]
    add(late[late.apply(lambda r: outside(r, "v_raw", False), axis=1)])
    got_totals = {}
    for n, st, p in fused:
        assert expected.get((st, p)) is not None
        got_totals[(st, p)] = got_totals.get((st, p), 0) + n
    assert got_totals == {k: v for k, v in expected.items() if v > 0}


@pytest.mark.parametrize("tz", ["America/Chicago", "Europe/Berlin", "Pacific/Apia", "Asia/Kolkata"])
def test_coarse_upper_bound_is_a_superset(tz):
    from linewatch.functions.time import coarse_source_upper

    rng = random.Random(4)
    zone = ZoneInfo(tz)
    for _ in range(3000):
        utc = datetime(2011, 1, 1) + timedelta(minutes=rng.randint(0, 60 * 24 * 365 * 3))
        local = utc.replace(tzinfo=ZoneInfo("UTC")).astimezone(zone).replace(tzinfo=None)
        end = local + timedelta(minutes=rng.randint(0, 600))
        # the row passes the exact test (local <= end), so it must pass the coarse one
        assert utc < coarse_source_upper(end, "UTC", tz)
