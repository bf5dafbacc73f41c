import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.functions.quantiles import exact_percentiles
from fleetgauge.operators import rolling as RO
from fleetgauge.operators import stats as ST
from fleetgauge.operators.regions import match_regions, regions
from fleetgauge.functions.scalars import threshold_gt
from tests.data import START, by, matrix

# The published example and its results.
SQUARE = [[1, 2, 3], [4, 5, 6], [7, 8, 9]]


def test_known_values_of_the_square(spark):
    df = matrix(spark, SQUARE)
    z = ST.zscore_time(df)
    assert z.count() == 9
    assert z.where("node = 'n0' AND win = 0").first()["z"] == pytest.approx(1.2247, abs=1e-4)
    p = {r.node: r.p99 for r in ST.node_percentile(df, [99]).collect()}
    assert len(p) == 3 and p["n0"] == pytest.approx(2.98)
    flags = df.select("node", "win", threshold_gt("e", 2).alias("flag"))
    assert flags.count() == 9 and flags.where("node = 'n0' AND win = 0").first()["flag"] == 0


def test_working_mean_skips_idle_machines(spark):
    errors = matrix(spark, [[1, 2, 3, 4, 5], [6, 7, 8, 9, 10], [11, 12, 13, 14, 15]])
    alloc = matrix(spark, [[0, 0, 1, 1, 1], [0, 1, 1, 1, 1], [1, 1, 1, 1, 1]], "cpus_alloc")
    both = ST.join_alloc(errors, alloc)
    assert [x for _, x in by(ST.working_mean(both), "ts", "working_e")] == [11, 9.5, 8, 9, 10]
    idle = both.withColumn("cpus_alloc", F.lit(0))
    assert {r.working_e for r in ST.working_mean(idle).collect()} == {0.0}


@pytest.mark.parametrize("keys", [[], ["node"]])
def test_exact_percentiles_agree_with_numpy(spark, keys):
    rng = random.Random(7)
    rows = [
        [rng.choice([0.0, -1.5, rng.gauss(0, 1e-3), rng.gauss(0, 1e6), rng.random()]) for _ in range(700)],
        [4.25] * 31,
        [rng.lognormvariate(0, 3) for _ in range(2)] + [None],
        [-9.0],
    ]
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = exact_percentiles(matrix(spark, rows), keys, "e", probs).collect()
    groups = {f"n{k}": [x for x in r if x is not None] for k, r in enumerate(rows)}
    if not keys:
        groups = {None: sum(groups.values(), [])}
    assert len(got) == len(groups)
    for row in got:
        values = groups[row["node"] if keys else None]
        for name, p in probs.items():
            assert row[name] == pytest.approx(np.percentile(values, p * 100), rel=1e-12, abs=1e-15)


def _padded(x, w):
    full = np.concatenate([np.full(w - 1, np.mean(x)), x])
    return np.array([full[k : k + w].mean() for k in range(len(x))])


@pytest.mark.parametrize("block", [7, 16, 4096])
def test_rolling_mean_is_the_same_in_any_block_length(spark, block):
    rng = np.random.default_rng(3)
    rows = [rng.normal(size=90), rng.normal(size=90), np.full(90, 2.0)]
    out = RO.rolling_mean(matrix(spark, rows), ["node"], "win", "e", 12, block=block)
    for k, row in enumerate(rows):
        got = [m for _, m in by(out.where(F.col("node") == f"n{k}"), "win", "m")]
        assert np.allclose(got, _padded(row, 12))


def test_rolling_mean_of_width_one_changes_nothing(spark):
    out = RO.rolling_mean(
        matrix(spark, SQUARE), ["node"], "win", "e", 1
    )
    assert all(r.m == pytest.approx(r.e) for r in out.collect())


@pytest.mark.parametrize("trim", ["tail", "warmup"])
def test_trim_decides_which_end_is_left_out(spark, trim):
    x = np.arange(40.0) ** 1.5
    out = RO.long_short_diff(matrix(spark, [x]), [], "win", "e", 10, 4, trim)
    diff = _padded(x, 4) - _padded(x, 10)
    want = diff[:30] if trim == "tail" else diff[10:]
    got = by(out, "win", "diff")
    assert [w for w, _ in got] == (list(range(30)) if trim == "tail" else list(range(10, 40)))
    assert np.allclose([d for _, d in got], want)
    with pytest.raises(ValueError):
        RO.long_short_diff(matrix(spark, [x]), [], "win", "e", 10, 4, "middle")


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_regions_cover_the_flagged_steps_once(spark, block):
    bits = [[0, 1, 1, 0, 1, 1, 1, 1, 1, 1, 0, 1], [1] * 12, [0] * 12]
    found = regions(matrix(spark, bits, "flag"), ["node"], block=block)
    got = by(found, "node", "first_step", "last_step")
    assert got == [("n0", 1, 2), ("n0", 4, 9), ("n0", 11, 11), ("n1", 0, 11)]


def test_a_long_region_matches_an_incident_once(spark):
    found = spark.sql("SELECT 0 AS first_step, 9 AS last_step, TIMESTAMP '2024-01-01 00:00:00' AS start_ts, TIMESTAMP '2024-01-09 00:00:00' AS end_ts")
    known = spark.sql("SELECT 1 AS id, TIMESTAMP '2023-12-30 00:00:00' AS date_start, TIMESTAMP '2024-01-05 00:00:00' AS date_end")
    assert match_regions(found, known).count() == 1


def test_entropy_lies_between_zero_and_all_different(spark):
    rows = [[1] * 20, list(range(20)), [0, 1] * 10]
    out = ST.window_entropy(matrix(spark, rows, "a"), ["a"], 8, 2, block=5)
    got = {}
    for r in out.collect():
        got.setdefault(r.node, []).append(r.entropy)
    assert {k: len(v) for k, v in got.items()} == {"n0": 7, "n1": 7, "n2": 7}
    assert np.allclose(got["n0"], 0) and np.allclose(got["n1"], math.log2(8)) and np.allclose(got["n2"], 1)


def test_constant_errors_have_no_zscore(spark):
    assert {r.z for r in ST.zscore_time(matrix(spark, [[0.5] * 4])).collect()} == {None}
    counts = ST.flag_counts(matrix(spark, [[0.5] * 4])).first()
    assert counts["n_z2"] == 0 and counts["n_over95"] == 0


def test_contributions_add_up_to_one(spark):
    from fleetgauge.plans.realtime import node_contribution

    judged = spark.createDataFrame([("a", 1.0), ("b", -3.0), ("c", 6.0)], "node string, last_diff double")
    assert sum(r.share for r in node_contribution(judged).collect()) == pytest.approx(1)
