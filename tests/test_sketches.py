"""Percentiles from sketches, and the status of the fleet as one document."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.functions.quantiles import percentiles, sketched_percentiles
from fleetgauge.functions.scalars import fleet_json

PROBS = {"p05": 0.05, "p50": 0.5, "p95": 0.95}


@pytest.mark.parametrize("rank_error", [0.02, 0.005])
def test_ranks_are_off_by_no_more_than_stated_on_skewed_keys(spark, rank_error):
    rng = np.random.default_rng(4)
    sizes = {"hot": 60_000, "b": 5_000, "c": 300, "d": 1}
    data = {k: np.round(rng.lognormal(0, 2, n), 3) for k, n in sizes.items()}
    df = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in xs], "node string, e double").repartition(7)
    rows = {r.node: r for r in sketched_percentiles(df, ["node"], "e", PROBS, rank_error).collect()}
    assert rows.keys() == sizes.keys()
    for node, xs in data.items():
        for name, p in PROBS.items():
            low, high = (xs < rows[node][name]).mean(), (xs <= rows[node][name]).mean()  # ties span ranks
            assert low - rank_error - 1 / len(xs) <= p <= high + rank_error + 1 / len(xs)
            assert rows[node][name] in xs


def test_one_shuffle_with_a_partial_aggregate(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("node"), F.col("id").cast("double").alias("e"))
    plan = sketched_percentiles(df, ["node"], "e", PROBS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("partial_kll") > plan.index("Exchange")


def test_nulls_empty_tables_and_the_choice_of_form(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", 3.0), ("b", None)], "node string, e double")
    assert [tuple(r) for r in percentiles(df, ["node"], "e", {"m": 1.0}, 0.01).collect()] == [("a", 3.0)]
    assert [tuple(r) for r in percentiles(df, ["node"], "e", {"m": 0.5}).collect()] == [("a", 2.0)]
    assert sketched_percentiles(df.limit(0), [], "e", PROBS).count() == 0
    with pytest.raises(ValueError):
        sketched_percentiles(df, ["node"], "e", PROBS, 0.0)


def test_the_fleet_in_one_document(spark):
    df = spark.createDataFrame([("b", 2, None), ("a", 1, True), (None, 3, True)], "node string, r_err int, is_anomaly boolean")
    text = fleet_json(df).first()["status"]
    assert json.loads(text) == {"a": {"r_err": 1, "is_anomaly": True}, "b": {"r_err": 2, "is_anomaly": None}} and text.index('"a"') < text.index('"b"')
    assert fleet_json(df.limit(0)).first()["status"] == "{}"
    with pytest.raises(Exception, match="more than 1 machines"):
        fleet_json(df, 1).collect()
