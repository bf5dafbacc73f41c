"""Centres under time warping and learners against plain NumPy."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import clusters as C
from fleetgauge.operators import models as M
from tests.data import by


def _plain(center, one):
    """Distance and values aligned to each centre step, cell by cell."""
    n, m = len(center), len(one)
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0
    for i in range(n):
        for j in range(m):
            cost[i + 1, j + 1] = np.square(center[i] - one[j]).sum() + min(cost[i, j], cost[i, j + 1], cost[i + 1, j])
    i, j, aligned = n, m, [[] for _ in range(n)]
    while i and j:
        aligned[i - 1].append(one[j - 1])
        pick = int(np.argmin([cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1]]))
        i, j = i - (pick != 2), j - (pick != 1)
    return np.sqrt(cost[n, m]), aligned


@pytest.mark.parametrize("channels", [1, 3])
def test_one_round_equals_a_round_by_hand(spark, channels):
    x = np.random.default_rng(6).normal(size=(12, 7, channels))
    s = spark.createDataFrame([(k, v.ravel().tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    start = [r.id for r in s.orderBy(F.xxhash64("id"), "id").limit(3).collect()]
    labels, centers = C.dtw_kmeans(s, 3, 1, channels)
    mine = [int(np.argmin([_plain(x[c], one)[0] for c in start])) for one in x]
    for c in range(3):
        aligned = [_plain(x[start[c]], one)[1] for one, label in zip(x, mine) if label == c]
        want = [np.mean([v for a in aligned for v in a[step]], axis=0) for step in range(7)]
        assert np.allclose(np.array(centers[c]).reshape(7, channels), want)
    now = [np.array(c).reshape(7, channels) for c in centers]
    want = [(k, int(np.argmin([_plain(c, one)[0] for c in now]))) for k, one in enumerate(x)]
    assert by(labels, "id", "label") == want


def test_alignment_holds_a_byte_per_cell():
    x = np.random.default_rng(7).normal(size=(4, 300, 1))
    tracemalloc.start()
    C._align(x[0], x)
    assert tracemalloc.get_traced_memory()[1] < 3 * 300 * 300 * 4
    tracemalloc.stop()


def test_principal_axes_equal_numpy(spark):
    x = np.random.default_rng(8).normal(size=(60, 5)) * [5, 3, 2, 1, 0.5]
    s = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "id long, v array<double>, label int")
    out = M.pca3(s)[0]
    values = [c for c in out.columns if c != "id"]
    got = np.array([np.ravel([r[c] if not isinstance(r[c], list) else r[c] for c in values])[:3] for r in out.orderBy("id").collect()], float)
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :3]
    for shift in (0, x.mean(0)):
        want = (x - shift) @ axes
        if np.allclose(np.abs(got), np.abs(want), atol=1e-6):
            return
    raise AssertionError("no match")
