"""Gaps, nulls, NaN, repeated steps and ties: one rule for each, the same in every operator."""

import json
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.functions.blocks import trailing_sums
from fleetgauge.functions.quantiles import exact_percentiles
from fleetgauge.operators import clusters as C
from fleetgauge.operators import neighbours as N
from fleetgauge.operators import regions as R
from fleetgauge.operators.errors import recon_losses, window_errors
from fleetgauge.operators.grid import time_grid
from fleetgauge.operators.reconstruct import score_series, score_windows
from fleetgauge.operators.errors import array_errors
from fleetgauge.operators.rolling import long_short_diff, rolling_mean
from fleetgauge.operators.stats import flag_counts, window_entropy
from fleetgauge.operators.windows import sliding_windows
from fleetgauge.sources.readers import import_error_table
from fleetgauge.sources.writers import newest_status
from fleetgauge.streaming import live
from tests.data import START, by

CH = ["p", "q"]


def _series(spark, steps, value=lambda i: float(i)):
    rows = [("a", START + timedelta(hours=i), i, value(i), 1.0) for i in steps]
    return spark.createDataFrame(rows, "node string, ts timestamp, i int, p double, q double")


def test_constant_errors_stay_constant_and_raise_no_flag(spark):
    df = spark.range(9000).select(
        F.lit("a").alias("node"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").cast("int").alias("i"),
        F.lit(0.001).alias("p"), F.lit(0.0).alias("p_hat"),
    )
    errors = window_errors(df, ["p"], window=60).select("node", "win", "ts", F.col("l1").alias("e")).cache()
    assert errors.select("e").distinct().count() == 1
    flags = flag_counts(errors).agg(*[F.sum(c) for c in ("n_z2", "n_z3", "n_over95")]).first()
    assert tuple(flags) == (0, 0, 0)


@pytest.mark.parametrize("bad", [float("nan"), float("inf")])
def test_a_bad_value_is_gone_after_the_width(spark, bad):
    df = _series(spark, range(40), lambda i: bad if i == 10 else 1.0)
    for block in (16, 4096):
        sums = {r.i: r.p_s3 for r in trailing_sums(df, ["node"], "i", ["p"], [3], block=block).collect()}
        assert [i for i, s in sums.items() if not np.isfinite(s)] and all((10 <= i <= 12) == (not np.isfinite(s)) for i, s in sums.items())


def test_windows_with_a_missing_step_or_value_are_left_out_everywhere(spark):
    df = _series(spark, [i for i in range(30) if i not in range(10, 15)], lambda i: None if i == 22 else float(i))
    wanted = [w for w in range(26) if not any(i in (10, 11, 12, 13, 14, 22) for i in range(w, w + 5))]
    for block in (8, 4096):
        wins = sliding_windows(df, CH, 5, 1, block)
        assert [w for (w,) in by(wins, "win")] == wanted
        assert all(len(r.p) == len(r.q) == 5 for r in wins.collect())
        assert [w for (w,) in by(window_entropy(df, CH, 5, 1, block), "win")] == wanted
        series = by(score_series(df, lambda b: b * 0, CH, 5, 1, block), "win", "l1")
        assert [w for w, _ in series] == wanted
        assert series == by(array_errors(score_windows(wins, lambda b: b * 0, CH), CH), "win", "l1")
        hat = df.withColumns({"p_hat": F.lit(0.0), "q_hat": F.lit(0.0)})
        assert [w for (w,) in by(window_errors(hat, CH, window=5, block=block), "win")] == wanted
        cells = [(float(i), 1.0) for w in wanted for i in range(w, w + 5)]
        losses = recon_losses(hat, CH, 5, 1, block).first()
        assert losses.mse == pytest.approx(np.mean([p * p + q * q for p, q in cells]))
        assert losses.mae == pytest.approx(np.mean([[p, q] for p, q in cells]))


def test_moving_means_do_not_depend_on_the_block(spark):
    df = _series(spark, [i for i in range(150) if i not in range(60, 100)])
    runs = [by(rolling_mean(df, ["node"], "i", "p", 30, block=b), "i", "m") for b in (16, 64, 4096)]
    assert runs[0] == runs[1] == runs[2]
    kept = by(long_short_diff(df, ["node"], "i", "p", 30, 10), "i")
    assert [i for (i,) in kept] == [i for i in range(120) if i not in range(60, 100)]


def test_of_several_readings_in_a_step_the_newest_counts(spark):
    rows = [("a", START, 1.0), ("a", START + timedelta(seconds=1), 2.0), ("a", START + timedelta(seconds=61), 3.0)]
    grid = time_grid(spark.createDataFrame(rows, "node string, ts timestamp, p double"), ["p"])
    assert by(grid, "i", "p") == [(0, 2.0), (1, 3.0)]


def test_false_alarms_are_told_apart_by_machine(spark):
    hour = lambda h: START + timedelta(hours=h)
    found = spark.createDataFrame(
        [("a", 5, 6, hour(5), hour(6)), ("b", 5, 7, hour(50), hour(52))], "node string, first_step int, last_step int, start_ts timestamp, end_ts timestamp"
    )
    truth = spark.createDataFrame([(1, hour(4), hour(6))], "id int, date_start timestamp, date_end timestamp")
    got = by(R.regions_vs_truth(found, truth), "outcome", "node")
    assert got == [("detected", "a"), ("false_alarm", "b")]


def test_error_tables_over_several_lines(spark, tmp_path):
    path = str(tmp_path / "table.json")
    with open(path, "w") as out:
        json.dump({"columns": ["x", "y"], "data": [[1, 2], [3, 4]]}, out, indent=2)
    assert by(import_error_table(spark, path, multi_line=True), "row", "name", "e") == [(0, "x", 1), (0, "y", 2), (1, "x", 3), (1, "y", 4)]
    with pytest.raises(Exception):
        import_error_table(spark, path).collect()
    with open(path, "w") as out:
        out.write('{"data": [[1]]}')
    with pytest.raises(Exception, match="without columns"):
        import_error_table(spark, path).collect()


def test_percentiles_leave_nan_out(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0, float("nan"), None)], "e double")
    assert tuple(exact_percentiles(df, [], "e", {"m": 0.5, "top": 1.0}).first()) == (2.5, 4.0)


def test_neighbours_set_aside_series_with_nan(spark):
    rows = [(0, [0.0, 0.0]), (1, [0.1, 0.0]), (2, [9.0, 0.0]), (3, [float("nan"), 0.0]), (4, None)]
    got = by(N.knn(spark.createDataFrame(rows, "id long, v array<double>"), 1, 0.5), "a", "b")
    assert got == [(0, 1), (1, 0), (2, 1)]


def test_neighbours_of_clustered_series_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.1, (20, 16)) for c in (0, 3, 6)])
    s = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = sorted((a, int(b)) for a in range(60) for b in np.argsort(d[a], kind="stable")[:3])
    assert by(N.knn(s, 3, 0.4), "a", "b") == want


def test_too_few_merges_for_the_clusters_wanted_are_an_error(spark):
    s = spark.createDataFrame([(k, [float(k * k)]) for k in range(5)], "id long, v array<double>")
    with pytest.raises(ValueError, match="larger radius"):
        C.cut_linkage(s, C.linkage_table(s, N.within(s, 1.5)), 2)


def test_of_equal_times_the_later_batch_has_the_status(spark):
    rows = [("a", 1.0, False, START, 3), ("a", 2.0, True, START, 4)]
    status = spark.createDataFrame(rows, "node string, r_err double, is_anomaly boolean, as_of timestamp, batch long")
    assert by(newest_status(status), "r_err") == [(2.0,)]


def test_publications_hold_every_machine_and_old_days_go(spark, tmp_path):
    schema = "node string, r_err double, is_anomaly boolean, as_of timestamp"
    path = str(tmp_path / "status")
    live.publish(spark.createDataFrame([("a", 1.0, False, START), ("b", 1.0, False, START)], schema), 0, path)
    for batch in (1, 1, 2):  # a batch that runs again changes nothing
        live.publish(spark.createDataFrame([("a", 1.0 + batch, True, START)], schema), batch, path)
    assert by(live.read_status(spark, path), "node", "r_err") == [("a", 3.0), ("b", 1.0)]
    history = str(tmp_path / "history")
    for day in range(5):
        live.append_history(spark.createDataFrame([("a", START + timedelta(days=day), 1.0)], "node string, ts timestamp, p double"), day, history)
    live.expire_history(spark, history, 24)
    assert spark.read.parquet(history).select("day").distinct().count() == 3
    assert live.read_history(spark, history, 24).count() == 1


def test_no_status_while_the_history_is_short(spark):
    history = _series(spark, range(5)).drop("i")
    assert live.status_scorer(CH, 3600, window=4, windows=10)(history).count() == 0
    assert live.fleet_scorer(CH, 3600, window=4, windows=10)(history.limit(0)).count() == 0


def test_readings_of_one_step_meet_before_they_move(spark):
    df = spark.createDataFrame([("a", START, 1.0)] * 5, "node string, ts timestamp, p double")
    plan = time_grid(df, ["p"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_max") == 1
    below = plan[plan.index("partial_max") :]
    assert plan.index("Exchange hashpartitioning(node") < plan.index("partial_max") and "REPARTITION_BY_COL" not in below


def test_unfolded_steps_are_neither_joined_nor_broadcast(spark):
    hour = lambda h: START + timedelta(hours=h)
    far = 3 * 4096 + 5
    rows = [("a", hour(0), 1.0), ("a", hour(4096), 2.0), ("a", hour(4095), None), ("b", hour(far), 3.0), (None, hour(7), 4.0), ("c", None, 5.0)]
    grid = time_grid(spark.createDataFrame(rows, "node string, ts timestamp, p double"), ["p"], 3600)
    plan = grid.where(F.coalesce("p", F.lit(0.0)) > 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # the few bytes of the axis before it unfolds would let it be sent whole to every task
    got = {(r.node, r.i): r.p for r in grid.collect()}
    assert grid.count() == len(got) == 4 * (far + 1)
    assert {k: p for k, p in got.items() if p is not None} == {("a", 0): 1.0, ("a", 4096): 2.0, ("b", far): 3.0}
    assert {r.ts for r in grid.where("i = 4097").collect()} == {hour(4097)}
    filled = time_grid(spark.createDataFrame(rows, "node string, ts timestamp, p double"), ["p"], 3600, 0.0)
    assert filled.where("p = 0").count() == 4 * (far + 1) - 3
