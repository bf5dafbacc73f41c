"""A linear bottleneck fitted without writing windows out."""

from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import reconstruct as RC
from fleetgauge.operators import windows as WN
from tests.data import START


def _steps(spark, gaps=(), nodes=3, steps=90, seed=0):
    rng = np.random.default_rng(seed)
    rows = [
        (f"n{n}", START + timedelta(minutes=i), i, float(50 + np.sin(i / 5 + n) + rng.normal(0, 0.1)), None if (n, i) == (1, 40) else float(rng.normal(0, 2)))
        for n in range(nodes) for i in range(steps) if (n, i) not in gaps
    ]
    return spark.createDataFrame(rows, "node string, ts timestamp, i int, p double, q double")


@pytest.mark.parametrize("rows,width,window,slide", [(80, 2, 7, 1), (80, 3, 6, 4), (60, 1, 5, 9), (30, 2, 30, 1), (40, 2, 1, 1)])
def test_cross_sums_are_those_of_the_windows(rows, width, window, slide):
    rng = np.random.default_rng(rows + slide)
    x = rng.normal(size=(rows, width))
    starts = np.arange(0, rows - window + 1, slide)
    starts = starts[(starts < rows // 2) | (starts >= rows // 2 + window)]  # two runs where there is room
    flat = np.stack([x[s : s + window].T.reshape(-1) for s in starts])
    total, gram = RC.cross_sums(x, starts, window, slide)
    assert np.allclose(total, flat.sum(axis=0), atol=1e-10) and np.allclose(gram, flat.T @ flat, atol=1e-10)


@pytest.mark.parametrize("slide,block", [(1, 4096), (1, 16), (3, 20)])
def test_same_axes_as_from_written_windows(spark, slide, block):
    df = _steps(spark, gaps={(0, 20), (2, 55)})
    mean, axes = RC.fit_linear(WN.sliding_windows(df, ["p", "q"], 6, slide), ["p", "q"], 4)
    own_mean, own_axes = RC.fit_linear_series(df, ["p", "q"], 6, slide, 4, block)
    assert np.allclose(own_mean, mean, atol=1e-9)
    signs = np.sign((own_axes * axes).sum(axis=0))
    assert np.allclose(own_axes * signs, axes, atol=1e-9)


def test_no_window_and_values_that_are_no_numbers(spark):
    df = _steps(spark)
    with pytest.raises(ValueError):
        RC.fit_linear_series(df.limit(0), ["p", "q"], 6)
    odd = df.withColumn("p", F.when((F.col("node") == "n0") & (F.col("i") == 30), float("nan")).otherwise(F.col("p")))
    hole = df.withColumn("p", F.when((F.col("node") == "n0") & (F.col("i") == 30), None).otherwise(F.col("p")))
    a, b = RC.fit_linear_series(odd, ["p", "q"], 6, latent=3), RC.fit_linear_series(hole, ["p", "q"], 6, latent=3)
    assert np.allclose(a[0], b[0]) and np.allclose(np.abs(a[1]), np.abs(b[1]))
