"""Dyadic buckets against plain comparisons of every pair."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.operators.filters import remove_period_table, remove_periods
from fleetgauge.operators.intervals import around, cover, overlap_totals, overlapping
from tests.data import by

START = datetime(1969, 12, 30)  # buckets before 1970 have negative numbers


def _times(rng, n, hours=400):
    return [START + timedelta(microseconds=int(x)) for x in rng.integers(0, hours * 3600 * 1_000_000, n)]


def _spans(rng, n, hours=400):
    """Of all lengths, some of a moment, some ending before they begin, some on whole hours."""
    out = []
    for k, a in enumerate(_times(rng, n, hours)):
        size = timedelta(seconds=float(2.0 ** rng.uniform(-2, 21)))
        a = a.replace(minute=0, second=0, microsecond=0) if k % 3 == 0 else a
        size = timedelta(hours=int(size.total_seconds() // 3600)) if k % 5 == 0 else size
        size = timedelta(0) if k % 11 == 0 else -size if k % 13 == 0 else size
        out.append((k, f"n{k % 3}", a, a + size))
    return out


def test_a_cover_is_whole_and_short(spark):
    rng = np.random.default_rng(0)
    rows = [(int(a), int(a + n)) for a, n in zip(rng.integers(-5000, 5000, 300), [*range(100), *rng.integers(0, 90000, 200)], strict=True)]
    got = cover(spark.createDataFrame(rows, "f long, l long"), F.col("f"), F.col("l")).collect()
    held = {}
    for r in got:
        held.setdefault((r.f, r.l), []).append((r["_at"] << r["_level"], (r["_at"] + 1) << r["_level"]))
    assert held.keys() == set(rows)
    for (f, last), parts in held.items():
        parts = sorted(set(parts))
        assert parts[0][0] == f and parts[-1][1] == last + 1 and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
        assert len(parts) <= 2 * np.log2(last - f + 1) + 2
    ten_years = cover(spark.sql("SELECT 1L AS f, 87660L AS l"), F.col("f"), F.col("l"))
    assert ten_years.count() <= 2 * 17
    assert cover(spark.sql("SELECT 5L AS f, 4L AS l"), F.col("f"), F.col("l")).count() == 0


@pytest.mark.parametrize("grain", [60, 3600, 86400 * 30])
def test_points_and_intervals_are_those_of_every_pair(spark, grain):
    rng = np.random.default_rng(grain)
    spans, times = _spans(rng, 90), [*_times(rng, 60), START, START + timedelta(hours=3)]
    points = spark.createDataFrame([(k, f"n{k % 3}", t) for k, t in enumerate(times)], "p long, node string, at timestamp")
    right = spark.createDataFrame([*spans, (900, "n0", None, START), (901, "n0", START, None)], "id long, node string, start_ts timestamp, end_ts timestamp")
    got = by(around(points, "at", right, "start_ts", "end_ts", ["node"], grain), "p", "id")
    assert got == sorted((p, k) for p, t in enumerate(times) for k, node, a, b in spans if a <= t <= b and node == f"n{p % 3}")
    other = _spans(rng, 70)
    left = spark.createDataFrame([(k, a, b) for k, _, a, b in other], "k long, a timestamp, b timestamp")
    pairs = by(overlapping(left, right.drop("node"), ("a", "b"), ("start_ts", "end_ts"), grain), "k", "id")
    assert pairs == sorted((k, i) for k, _, a, b in other if a <= b for i, _, c, d in spans if c <= d and a <= d and c <= b)


@pytest.mark.parametrize("grain_keys", [None, ["node"]])
def test_rows_outside_a_table_of_periods(spark, grain_keys):
    rng = np.random.default_rng(8)
    spans = [s for s in _spans(rng, 25, 2000) if (s[3] - s[2]).total_seconds() < 400_000]
    times = [START + timedelta(minutes=20 * k) for k in range(6000)]
    df = spark.createDataFrame([(k, f"n{k % 4}", t) for k, t in enumerate(times)] + [(-1, "n0", None)], "k long, node string, ts timestamp")
    periods = spark.createDataFrame(spans, "id long, node string, start_ts timestamp, end_ts timestamp")
    got = [k for (k,) in by(remove_period_table(df, periods, grain_keys), "k")]
    inside = {k for k, t in enumerate(times) for _, node, a, b in spans if a <= t <= b and (not grain_keys or node == f"n{k % 4}")}
    assert got == [-1, *(k for k in range(len(times)) if k not in inside)] and 0 < len(inside) < len(times)
    assert remove_period_table(df, periods.limit(0), grain_keys).count() == len(times) + 1
    assert remove_period_table(df.limit(0), periods, grain_keys).count() == 0


def test_ten_thousand_periods_and_one_of_ten_years(spark):
    rng = np.random.default_rng(2)
    df = spark.range(20000).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 600).alias("ts"))
    starts = rng.integers(1_700_000_000, 1_712_000_000, 10_000)
    table = spark.createDataFrame([(int(s), int(s + n)) for s, n in zip(starts, rng.integers(1, 900, 10_000), strict=True)], "s long, e long")
    periods = table.select(F.timestamp_seconds("s").alias("start_ts"), F.timestamp_seconds("e").alias("end_ts"))
    seconds = 1_700_000_000 + 600 * np.arange(20000)
    deltas = np.zeros(20_000_000, int)
    for r in table.collect():
        deltas[r.s - 1_700_000_000] += 1
        deltas[r.e + 1 - 1_700_000_000] -= 1
    inside = np.cumsum(deltas)[seconds - 1_700_000_000] > 0
    assert [k for (k,) in by(remove_period_table(df, periods), "id")] == np.flatnonzero(~inside).tolist()
    long = spark.sql("SELECT TIMESTAMP '2015-01-01 00:30:00' AS start_ts, TIMESTAMP '2025-01-01 00:30:00' AS end_ts")
    assert remove_period_table(df, periods.unionByName(long)).count() == 0


def test_the_table_form_agrees_with_the_list(spark):
    df = spark.range(500).select("id", F.timestamp_seconds(F.col("id") * 3600).alias("ts"))
    gaps = [("1970-01-03", "1970-01-05"), ("1970-01-05", "1970-01-06 07:00:00")]
    table = spark.createDataFrame(gaps, "a string, b string").select(F.col("a").cast("timestamp").alias("start_ts"), F.col("b").cast("timestamp").alias("end_ts"))
    assert by(remove_period_table(df, table), "id") == by(remove_periods(df, gaps), "id")


def test_totals_of_overlaps_need_no_pairs(spark):
    rng = np.random.default_rng(5)
    spans, other = _spans(rng, 80), _spans(rng, 60)
    right = spark.createDataFrame([*spans, (900, "n0", None, START)], "id long, node string, start_ts timestamp, end_ts timestamp").drop("node")
    left = spark.createDataFrame([(f"m{k % 20}", a, b) for k, _, a, b in other], "m string, a timestamp, b timestamp")
    totals = overlap_totals(left, right, ("a", "b"), ("start_ts", "end_ts"), "m", "first_start")
    assert "NestedLoop" not in totals._jdf.queryExecution().executedPlan().toString()
    want = {}
    for k, _, a, b in other:
        met = [c for _, _, c, d in spans if a <= b and c <= d and a <= d and c <= b]
        if met:
            n, first = want.get(f"m{k % 20}", (0, met[0]))
            want[f"m{k % 20}"] = n + len(met), min(first, *met)
    assert {r.m: (r.n, r.first_start) for r in totals.collect()} == want


def test_rows_of_a_machine_meet_its_periods_without_a_join(spark):
    """Every row is sent once: it met a row for each level of buckets, and several joins."""
    r = np.random.default_rng(8)
    start = datetime(2024, 1, 1)
    name = lambda: [None, "a", "b", "c"][int(r.integers(0, 4))]
    rows = [(name(), start + timedelta(minutes=int(m)) if m % 50 else None, int(m)) for m in r.integers(0, 400_000, 400)]
    spans = [(name(), start + timedelta(minutes=int(m)), start + timedelta(minutes=int(m + n))) for m, n in zip(r.integers(0, 400_000, 60), r.integers(-500, 9_000, 60), strict=True)]
    for more in ([], [("b", start - timedelta(days=20_000), start + timedelta(days=30))]):
        df = spark.createDataFrame(rows, "node string, ts timestamp, x long")
        periods = spark.createDataFrame(spans + more, "node string, start_ts timestamp, end_ts timestamp")
        out = remove_period_table(df, periods, ["node"])
        assert "Join" not in out._jdf.queryExecution().toString() and out.schema == df.schema
        want = [x for x in rows if x[1] is None or not any(p[0] is not None and p[0] == x[0] and p[1] <= x[1] <= p[2] for p in spans + more)]
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want)) and len(want) < len(rows)
