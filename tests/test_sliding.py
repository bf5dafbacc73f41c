"""Sliding sums of constant cost against sums of each frame by itself."""

import numpy as np
import pytest

from fleetgauge.functions.blocks import sliding_sums, trailing_sums
from fleetgauge.operators.rolling import long_short_diff


@pytest.mark.parametrize("n", [1, 2, 5, 17, 300])
@pytest.mark.parametrize("width", [1, 2, 7, 60, 180])
def test_sliding_sums(n, width):
    x = np.random.default_rng(n).normal(size=n)
    want = [x[max(0, k - width + 1) : k + 1].sum() for k in range(n)]
    assert np.allclose(sliding_sums(x, width), want, rtol=0, atol=1e-12)


def test_values_that_are_no_numbers_are_gone_after_the_width():
    x = np.ones(60)
    x[[20, 40]] = np.nan, np.inf
    got = sliding_sums(x, 7)
    assert np.flatnonzero(np.isnan(got)).tolist() == list(range(20, 27))
    assert np.flatnonzero(np.isinf(got)).tolist() == list(range(40, 47))


def test_frames_go_by_step_over_blocks(spark):
    r = np.random.default_rng(4)
    steps = sorted(r.choice(200, 120, replace=False).tolist())
    rows = [("a", k, None if k % 11 == 0 else float(r.normal())) for k in steps]
    df = spark.createDataFrame(rows, "node string, i int, x double")
    for block in (16, 64, 4096):
        for got in trailing_sums(df, ["node"], "i", ["x"], [5, 23], {"i": 5}, block=block).collect():
            for w in (5, 23):
                frame = [x for _, k, x in rows if got["i"] - w < k <= got["i"]]
                known = [x for x in frame if x is not None]
                assert got[f"_rows{w}"] == len(frame) and got[f"x_n{w}"] == len(known)
                assert abs(got[f"x_s{w}"] - sum(known)) < 1e-12
            assert got["i_first"] == (got["i"] - 4 if got["i"] - 4 in steps else None)


def test_a_constant_series_has_no_difference(spark):
    df = spark.createDataFrame([("a", k, 0.1) for k in range(500)], "node string, win int, e double")
    diffs = {r["diff"] for r in long_short_diff(df, ["node"], "win", "e", 180, 60, "warmup").collect()}
    assert len(diffs) == 1 and abs(diffs.pop()) < 1e-12
