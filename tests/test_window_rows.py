"""Written-out windows and scores of many machines: cut and scored many at once, no element sent twice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import errors as E
from fleetgauge.operators.reconstruct import fit_linear_series, score_series, score_windows
from fleetgauge.operators.windows import sliding_windows
from tests.data import START, by, matrix

FLEET = np.random.default_rng(5).normal(2, 1, (30, 14))


def _fleet(spark):
    return matrix(spark, FLEET, "a").withColumn("b", F.col("i").cast("int"))


@pytest.mark.parametrize("block", [5, 4096])
def test_windows_of_many_machines(spark, block):
    wins = sliding_windows(_fleet(spark), ["a", "b"], 4, 2, block)
    rows = {(r.node, r.win): r for r in wins.collect()}
    assert len(rows) == wins.count() == 30 * 6 and dict(wins.dtypes)["b"] == "array<int>"
    for (node, win), r in rows.items():
        assert r.a == FLEET[int(node[1:]), 2 * win : 2 * win + 4].tolist() and r.b == list(range(2 * win, 2 * win + 4))
        assert (r.start_ts - START).total_seconds() == 120 * win
    plan = wins._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "collect_list" not in plan


def test_elements_keep_the_start_of_their_window(spark):
    wins = sliding_windows(_fleet(spark), ["a"], 4, 4)
    cells = E.window_elements(wins, ["a"], ("start_ts",))
    assert cells.columns == ["node", "win", "start_ts", "channel", "off", "x"] and cells.count() == 30 * 3 * 4
    assert cells.groupBy("win").agg(F.count_distinct("start_ts").alias("n")).where("n <> 1").count() == 0


def test_both_sides_of_an_element_are_not_joined(spark):
    df = _fleet(spark).withColumns({"a_hat": F.when(F.col("i") != 9, F.col("a") + 1), "b_hat": F.col("b") * 2.0})
    both = E.orig_vs_recon(sliding_windows(df, ["a", "b", "a_hat", "b_hat"], 4, 4), ["a", "b"])
    assert "Join" not in both._jdf.queryExecution().toString()
    want = {(f"n{n}", w, o): (FLEET[n, 4 * w + o], FLEET[n, 4 * w + o] + 1) for n in range(30) for w in (0, 1) for o in range(4)}  # a step of window 2 is missing
    got = {(r.node, r.win, r.off): (r.x, r.x_hat) for r in both.where("channel = 'a'").collect()}
    assert got == want and both.count() == 2 * len(want)


def test_elements_without_a_machine_have_no_other_side(spark):
    df = _fleet(spark).withColumns({"node": F.when(F.col("node") != "n0", F.col("node")), "a_hat": F.lit(0.0)})
    wins = sliding_windows(df, ["a", "a_hat"], 4, 4)
    assert wins.where("node IS NULL").count() == 3 and E.orig_vs_recon(wins, ["a"]).count() == 29 * 3 * 4


def test_a_model_gets_the_windows_of_many_machines(spark):
    """A call per machine would cost more than the work where machines have few steps."""
    df = _fleet(spark).coalesce(1)

    together = score_series(df, lambda x: x - len(x), ["a", "b"], 4)  # the error tells how many windows a call got
    assert together.agg(F.max("l1")).first()[0] > 11.5
    with_null = df.withColumn("a", F.when(~((F.col("node") == "n3") & (F.col("i") == 13)), F.col("a")))
    got = by(score_series(with_null, lambda x: x * 0.5, ["a", "b"], 4), "node", "win", "l1_a")
    want = sorted((f"n{n}", w, np.abs(FLEET[n, w : w + 4]).mean() / 2) for n in range(30) for w in range(11) if (n, w) != (3, 10))
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def test_scored_windows_keep_their_arrays(spark):
    wins = sliding_windows(_fleet(spark), ["a", "b"], 4, 5)
    out = score_windows(wins, lambda x: x + np.arange(2)[None, :, None], ["a", "b"])
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    rows = out.collect()
    assert len(rows) == 90 and out.columns == ["node", "win", "start_ts", "a", "a_hat", "b", "b_hat"]
    assert all(r.a_hat == r.a and r.b_hat == [x + 1 for x in r.b] for r in rows)


def test_the_linear_fit_does_not_hang_on_how_products_are_added(spark, monkeypatch):
    from fleetgauge.operators import reconstruct

    df = _fleet(spark)
    mean, axes = fit_linear_series(df, ["a", "b"], 4, 1, 3)
    monkeypatch.setattr(reconstruct, "_OVERLAP", 0)
    again, other = fit_linear_series(df, ["a", "b"], 4, 1, 3)
    assert np.allclose(mean, again) and np.allclose(axes @ axes.T, other @ other.T)
