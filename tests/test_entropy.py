"""Entropy of sliding windows from one sort of a block, against counting each window."""

from collections import Counter

import numpy as np
import pytest

from fleetgauge.operators.stats import _block_entropy


def _plain(values, start, window):
    cells = [str(x) for x in values[start : start + window].ravel()]  # NaN equals NaN
    shares = np.array(list(Counter(cells).values())) / len(cells)
    return -(shares * np.log2(shares)).sum()


@pytest.mark.parametrize("rows,width,window,kinds", [(300, 4, 60, 9), (50, 1, 1, 3), (64, 3, 64, 2), (40, 2, 7, 1000)])
def test_every_window_is_counted_right(rows, width, window, kinds):
    rng = np.random.default_rng(rows)
    values = rng.integers(0, kinds, (rows, width)).astype(float)
    values[rng.random((rows, width)) < 0.05] = np.nan
    starts = np.arange(rows - window + 1)
    got = _block_entropy(values, starts, window)
    assert np.allclose(got, [_plain(values, s, window) for s in starts], atol=1e-12)


def test_long_blocks_do_not_drift_and_equal_values_have_none():
    values = np.random.default_rng(1).integers(0, 50, (60_000, 4)).astype(float)
    values[-100:] = 7.0
    starts = np.array([0, 30_000, 59_800, 59_940])
    got = _block_entropy(values, starts, 60)
    assert np.allclose(got, [_plain(values, s, 60) for s in starts], atol=1e-13) and got[-1] < 1e-13
    assert len(_block_entropy(values[:10], np.array([], dtype=int), 60)) == 0
