"""Many machines' blocks worked on at once, against plain sums machine by machine."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from fleetgauge.functions import blocks as B
from fleetgauge.operators.errors import profile_window_errors, window_errors
from fleetgauge.operators.reconstruct import apply_profile

START = datetime(2024, 1, 1)
CH = ["a", "b"]


def _steps(spark):
    r = np.random.default_rng(4)
    rows = []
    for n in range(40):
        for i in range(60):
            if not (n % 7 == 3 and i in (20, 21)):
                value = None if n == 5 and i == 30 else float("nan") if n == 6 and i == 10 else float(r.normal())
                rows.append((f"n{n:02d}", START + timedelta(hours=i), i, value, float(r.normal())))
    hats = [(f"n{n:02d}", h, float(r.normal()), None if n == 8 and h == 4 else 0.5) for n in range(38) for h in range(24) if (n, h) != (9, 7)]
    return spark.createDataFrame(rows, "node string, ts timestamp, i int, a double, b double"), spark.createDataFrame(hats, "node string, hour int, a_hat double, b_hat double")


def test_the_profile_goes_with_the_steps_and_nothing_is_joined(spark):
    steps, profile = _steps(spark)
    for block in (16, 4096):
        out = profile_window_errors(steps, profile, CH, ("L1", "L2"), 5, 2, block)
        assert "Join" not in out._jdf.queryExecution().toString()
        want = window_errors(apply_profile(steps, profile), CH, ("L1", "L2"), 5, 2, block)
        got, want = ({(r.node, r.win, r.ts): r for r in df.collect()} for df in (out, want))
        assert got.keys() == want.keys() and len(got) > 700
        for k, w in want.items():
            for c in ("l1_a", "l1_b", "l2_a", "l2_b", "l1", "l2"):
                assert np.isclose(got[k][c], w[c], rtol=0, atol=1e-12, equal_nan=True)


def test_a_call_takes_many_machines(spark):
    """A call for each machine cost more than its sums."""
    steps, _ = _steps(spark)
    calls = spark.sparkContext.accumulator(0)

    def run(rows, begins):
        calls.add(1)
        return rows.select(["node"]).take(begins)

    parts = B.with_halo(steps, "i", 0, 16)
    assert B.over_blocks(parts, ["node"], "i", run, "node string", 0).count() == 40 * 4
    assert calls.value <= 16


def test_sums_of_many_machines_are_those_of_each(spark):
    steps, _ = _steps(spark)
    keyed = steps.withColumn("node", F.when(F.col("node") != "n01", F.col("node")))  # a machine without a name is one too
    rows = B.trailing_sums(keyed, ["node"], "i", ["b"], [4, 9], {"ts": 4}, 16).collect()
    held = {(r.node, r.i): r.b for r in rows}
    assert len(rows) == len(held) == steps.count()
    for r in rows:
        for w in (4, 9):
            frame = [held[r.node, k] for k in range(r.i - w + 1, r.i + 1) if (r.node, k) in held]
            assert r[f"_rows{w}"] == r[f"b_n{w}"] == len(frame) and abs(r[f"b_s{w}"] - sum(frame)) < 1e-9
        begin = r.i - 3
        assert r.ts_first == (START + timedelta(hours=begin) if (r.node, begin) in held else None)
