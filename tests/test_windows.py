import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import errors as E
from fleetgauge.operators import grid as G
from fleetgauge.operators import reconstruct as RC
from fleetgauge.operators import scale as SC
from fleetgauge.operators import windows as WN
from fleetgauge.plans.realtime import detect_node_last
from fleetgauge.sources import readers, writers
from tests.data import START, by, matrix

STEPS = 50


def _two(spark, seed=1):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(3, STEPS)), rng.normal(size=(3, STEPS))
    left = matrix(spark, a, "a").join(matrix(spark, b, "b").select("node", "i", "b"), ["node", "i"])
    return left, a, b


@pytest.mark.parametrize("block", [13, 4096])
@pytest.mark.parametrize("slide", [1, 4])
def test_errors_equal_those_of_written_windows(spark, slide, block):
    df, a, b = _two(spark)
    both = df.withColumns({"a_hat": F.lit(0.25), "b_hat": F.col("b") / 2})
    got = {(r.node, r.win): r for r in E.window_errors(both, ["a", "b"], ("L1", "L2"), 10, slide, block=block).collect()}
    assert len(got) == 3 * ((STEPS - 10) // slide + 1)
    for (node, win), r in got.items():
        x, y = (m[int(node[1]), win * slide : win * slide + 10] for m in (a, b))
        assert r.l1_a == pytest.approx(np.abs(x - 0.25).mean()) and r.l2_b == pytest.approx(np.square(y / 2).mean())
        assert r.l1 == pytest.approx((r.l1_a + r.l1_b) / 2)


@pytest.mark.parametrize("block", [13, 4096])
def test_a_model_gives_the_same_errors_both_ways(spark, block):
    df, _, _ = _two(spark)

    def model(x):
        return x * 0.5

    short = RC.score_series(df, model, ["a", "b"], 10, 3, block)
    wins = WN.sliding_windows(df, ["a", "b"], 10, 3, block)
    long = E.array_errors(RC.score_windows(wins, model, ["a", "b"]), ["a", "b"])
    one, two = by(short, "node", "win", "l1"), by(long, "node", "win", "l1")
    assert len(one) == len(two) == 3 * 14
    assert np.allclose([x[2] for x in one], [x[2] for x in two])


def test_a_wrong_shape_from_the_model_fails(spark):
    df, _, _ = _two(spark)
    with pytest.raises(Exception, match="reshape"):
        RC.score_series(df, lambda x: x[:, :, :3], ["a", "b"], 10).collect()


def test_windows_do_not_cross_a_gap(spark):
    df, _, _ = _two(spark)
    cut = df.where(~F.col("i").between(20, 24)).withColumns({"a_hat": F.lit(0.0), "b_hat": F.lit(0.0)})
    wins = {r.win for r in E.window_errors(cut, ["a", "b"], window=10).collect()}
    assert wins == set(range(0, 11)) | set(range(25, 41))


def test_all_components_rebuild_the_windows(spark):
    df, _, _ = _two(spark)
    model = RC.fit_linear(WN.sliding_windows(df, ["a", "b"], 4, 1), ["a", "b"], 8)
    out = RC.score_series(df, RC.linear_reconstructor(model), ["a", "b"], 4)
    assert out.agg(F.max("l1")).first()[0] < 1e-9


def test_series_shorter_than_a_window_has_none(spark):
    df, _, _ = _two(spark)
    short = df.where("i < 5").withColumns({"a_hat": F.lit(0.0), "b_hat": F.lit(0.0)})
    assert E.window_errors(short, ["a"], window=10).count() == 0
    assert G.window_count(short, 10, 1).select("windows").distinct().first()[0] == 0
    with pytest.raises(Exception, match="fewer than"):
        WN.last_n_windows(E.window_errors(df.withColumns({"a_hat": F.lit(0.0)}), ["a"], window=10), 360).collect()


def test_scale_and_back(spark, tmp_path):
    df, _, _ = _two(spark)
    df = df.withColumn("c", F.lit(3.0))
    writers.save_scale(SC.fit_scale(df, ["a", "b", "c"]), str(tmp_path / "s"))
    scale = readers.load_scale(spark, str(tmp_path / "s"))
    there = SC.apply_scale(df, scale, ["a", "b", "c"])
    low, high, flat = there.agg(F.min("a"), F.max("a"), F.max("c")).first()
    assert (low, high, flat) == (0.0, 1.0, None)
    back = SC.revert_scale(there, scale, ["a"]).select("node", "i", F.col("a").alias("back")).join(df, ["node", "i"])
    assert back.agg(F.max(F.abs(F.col("a") - F.col("back")))).first()[0] < 1e-12


def test_grid_fills_missing_steps(spark):
    df = matrix(spark, [[1, 2, 3, 4], [5, 6, 7, 8]], "x").where("NOT (node = 'n1' AND i IN (1, 2))")
    grid = G.time_grid(df.select("node", "ts", "x"), ["x"], 60, 0.0)
    assert by(grid.where("node = 'n1'"), "i", "x") == [(0, 5.0), (1, 0.0), (2, 0.0), (3, 8.0)]
    assert grid.agg(F.min("ts")).first()[0] == START
    assert G.check_aligned(grid, df).collect()[0]["right_steps"] == 2
    assert G.truncate_to_slide(grid, 4).count() == 8 and G.truncate_to_slide(grid, 3).count() == 6


def test_node_files_round_trip(spark, tmp_path):
    df = matrix(spark, [[1, 2], [3, 4]], "power").withColumns({c: F.lit(0.5) for c in ("cpu1", "cpu2", "cpus_alloc")})
    writers.write_node_files(df, str(tmp_path / "t"))
    back = readers.read_node_table(spark, str(tmp_path / "t"))
    assert by(back, "node", "power") == by(df, "node", "power")
    df.where("node = 'n1'").withColumnRenamed("ts", "date").toPandas().to_parquet(tmp_path / "e1001.parquet")
    (tmp_path / "notes.txt").write_text("not a table")
    flat = readers.read_node_files(spark, str(tmp_path / "*.parquet"), ["power"])
    assert by(flat, "node", "power") == [("e1001", 3.0), ("e1001", 4.0)]


def test_only_the_late_fault_is_flagged(spark):
    x = 1 + 0.01 * np.sin(np.arange(400) / 5 + np.arange(6)[:, None])
    x[2, 385:] += 1
    errors = matrix(spark, x, "l1")
    flagged = detect_node_last(errors, trim="warmup").where("is_anomaly")
    assert [r.node for r in flagged.collect()] == ["n2"]


def test_no_plan_puts_a_fact_table_into_one_partition(spark):
    df, _, _ = _two(spark)
    both = df.withColumns({"a_hat": F.lit(0.0), "b_hat": F.lit(0.0)})
    plan = E.window_errors(both, ["a", "b"], window=10)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Python" not in plan
