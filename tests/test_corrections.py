"""Streamed counts that late rows correct, and rules in normal form."""

import random
import re
import tempfile
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import record, records
from linewatch.operators.limits import normal_form, out_of_spec, rules_frame
from linewatch.streaming import CorrectedCounts
from test_plans import _final_plan
from test_stream import SCHEMA, _write


def _batch_counts(rows):
    units = {(t.replace(minute=0, second=0), s, p, u) for u, s, p, t in rows if t is not None}
    return sorted((w, w + timedelta(hours=1), s, p, sum(1 for x in units if x[:3] == (w, s, p))) for w, s, p in {x[:3] for x in units})


def _got(df):
    return sorted(tuple(r) for r in df.collect())


def test_late_rows_replace_their_windows(spark):
    folder, kept = tempfile.mkdtemp(prefix="lw-in-"), tempfile.mkdtemp(prefix="lw-kept-")
    counts, rng, rows = CorrectedCounts(kept), random.Random(1), []
    name = f"corrected-{time.time_ns()}"
    for run in range(4):
        now = datetime(2024, 1, 15, 9) + timedelta(hours=2 * run)
        new = [(f"u{rng.randrange(9)}", "S", f"p{rng.randrange(2)}", now + timedelta(minutes=rng.randrange(120))) for _ in range(30)]
        # late by hours, some of them units that are counted already
        new += [(u, s, p, t - timedelta(minutes=7)) for u, s, p, t in rows[:5]] + [(f"late{run}", "S", "p0", datetime(2024, 1, 15, 9, 5))] + [("x", "S", "p0", None)]
        rows += new
        _write(folder, f"{run}.parquet", new)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        counts.run_available(stream, name)
        assert _got(counts.counts(stream)) == _batch_counts(rows)
    late = {(r.product_serial, r.recorded_at) for r in counts.late(stream).collect()}
    assert {("late1", datetime(2024, 1, 15, 9, 5)), ("late3", datetime(2024, 1, 15, 9, 5))} <= late and not any(u == "late0" for u, _ in late)


def test_a_batch_that_runs_again_counts_once(spark):
    kept = CorrectedCounts(tempfile.mkdtemp(prefix="lw-kept-"), failing=F.col("station_name") == "S")
    first = [("u1", "S", "p", datetime(2024, 1, 15, 9, 1)), ("u1", "S", "p", datetime(2024, 1, 15, 9, 2)), ("u2", "T", "p", datetime(2024, 1, 15, 9, 2))]
    second = [("u3", "S", "p", datetime(2024, 1, 15, 12, 0)), ("u4", "S", "p", datetime(2024, 1, 15, 9, 30))]
    third = [("u5", "S", "p", datetime(2024, 1, 15, 9, 40))]
    frames = [spark.createDataFrame(x, SCHEMA) for x in (first, second, third)]
    for batch_id, df in [(0, frames[0]), (0, frames[0]), (1, frames[1]), (1, frames[1]), (2, frames[2]), (2, frames[2]), (3, frames[0].limit(0))]:
        kept.apply(df, batch_id)
    assert _got(kept.counts(frames[0])) == _batch_counts([r for r in first + second + third if r[1] == "S"])
    assert [(r.product_serial, r.batch) for r in kept.late(frames[0]).collect()] == [("u5", f"{2:020d}")]


def test_nothing_has_come(spark):
    kept = CorrectedCounts(tempfile.mkdtemp(prefix="lw-kept-") + "/none")
    like = spark.createDataFrame([], SCHEMA)
    assert kept.counts(like).collect() == [] and kept.late(like).collect() == []
    assert kept.counts(like).columns == ["window_start", "window_end", "station_name", "parameter_name", "fail_count"]


def _fails(rows, rules, located):
    out = []
    for serial, _, param, _, loc, *_, num, _ in rows:
        own = [(low, high) for name, at, low, high in rules if name == param and (at is None or not located or at == loc)]
        if num is not None and any((low is not None and num < low) or (high is not None and num > high) for low, high in own):
            out.append(serial)
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("location", [None, "work_location_id"])
def test_folded_rules_equal_a_chain_of_ranges(spark, seed, location):
    rng = random.Random(seed)
    limit = lambda: rng.choice([None, rng.uniform(-5, 5), rng.uniform(-5, 5)])
    rules = [(rng.choice("abc"), rng.choice([None, 1, 2, 3]), limit(), limit()) for _ in range(12)]
    rows = [record(f"s{i}", rng.choice("abcd"), rng.choice([None, rng.uniform(-8, 8)]), loc=rng.choice([1, 2, 3, 4, None])) for i in range(300)]
    df = records(spark, rows)
    for most in (0, 500):
        got = sorted(r.product_serial for r in out_of_spec(df, rules_frame(spark, rules), "parameter_value_num", location, max_inline_rules=most).collect())
        # without a location column a rule holds everywhere, whatever its location
        assert got == _fails(rows, rules, location is not None)


def test_many_rules_of_a_hot_parameter_do_not_multiply_records(spark):
    rules = rules_frame(spark, [("hot", i % 50, -float(i), 100.0 + i) for i in range(3000)] + [("hot", None, -1e9, 1e9), ("cold", None, 0.0, 1.0)])
    everywhere, located = normal_form(rules, "work_location_id")
    assert everywhere.count() == 2 and located.count() == 50
    assert {(r._at_low, r._at_high) for r in located.where("_at_location = 7").collect()} == {(-7.0, 107.0)}
    df = records(spark, [record(f"s{i}", "hot", float(i % 120), loc=i % 60) for i in range(2000)])
    out = out_of_spec(df, rules, "parameter_value_num", "work_location_id", max_inline_rules=0)
    assert out.columns == df.columns
    assert out.count() == sum(1 for i in range(2000) if i % 60 < 50 and i % 120 > 100 + i % 60)
    plan = _final_plan(out).split("Initial Plan")[0]
    # the joins' keys are (parameter, location) and parameter, of which the rule sides have one row each
    assert len(re.findall(r"HashJoin|SortMergeJoin", plan)) == 3 and "work_location_id" in next(x for x in plan.splitlines() if "LeftOuter" in x), plan
