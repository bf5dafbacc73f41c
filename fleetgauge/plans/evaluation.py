"""Looking back over a whole test period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.scalars import threshold_ge
from fleetgauge.operators.errors import err_node, profile_window_errors
from fleetgauge.operators.regions import regions
from fleetgauge.operators.rolling import long_short_diff
from fleetgauge.operators.stats import (
    FLAGS,
    fleet_median,
    flagged,
    join_entropy,
    window_entropy,
    working,
    zscore_nodes,
)
from fleetgauge.plans.realtime import profile_errors
from fleetgauge.schema import LONG_MEAN, SHORT_MEAN_EVAL, SIGMAS, SLIDE, WINDOW
from fleetgauge.session import written

def metrics_panel(errors: DataFrame, digits: int | None = None) -> DataFrame:
    """Eight series per step from errors carrying `cpus_alloc`; these are worked out once."""
    errors = written(errors.select("node", "ts", "e", "cpus_alloc"), "panel")
    per_step = flagged(errors, digits).groupBy("ts").agg(
        F.avg("e").alias("mean_e"), working().alias("working_e"), *[F.sum(f).alias(f"n_{f}") for f in FLAGS]
    )
    return per_step.join(fleet_median(errors), "ts")


def smoothed(
    errors: DataFrame, long: int = LONG_MEAN, short: int = SHORT_MEAN_EVAL, trim: str = "tail"
) -> DataFrame:
    """Fleet median per step with long and short mean and their difference; the medians, a row per
    step, are written, as several later steps read them."""
    steps = errors.groupBy("ts").agg(F.min("win").alias("win"))
    series = written(fleet_median(errors).join(steps, "ts"), "medians")
    return long_short_diff(series, [], "win", "median_e", long, short, trim)


def threshold_sensitivity(smooth: DataFrame, sigmas: list[float] = SIGMAS, digits: int | None = None) -> DataFrame:
    """Flag per step and k: difference at or above mean + k deviations."""
    smooth = written(smooth.select("win", "ts", "diff"), "smooth")
    mean, deviation = smooth.agg(F.avg("diff"), F.stddev_pop("diff")).first()
    marks = F.array(
        *[
            F.struct(
                F.lit(float(k)).alias("k"),
                threshold_ge("diff", F.lit(mean) + F.lit(float(k)) * F.lit(deviation), digits).alias("flag"),
            )
            for k in sigmas
        ]
    )
    return smooth.select("win", "ts", "diff", F.inline(marks))


def detected_regions(flags: DataFrame, k: float | None = None) -> DataFrame:
    """Regions for one k, or for every k when none is named."""
    if k is not None:
        return regions(flags.where(F.col("k") == float(k)), [])
    return regions(flags, ["k"])


def zscore_panel(errors: DataFrame, sigmas: tuple[int, ...] = (1, 2, 3), digits: int | None = None) -> DataFrame:
    """Per step: mean z over machines and number of machines at or above each bound."""
    z = zscore_nodes(errors)
    counts = [F.sum(F.coalesce(threshold_ge("z", k, digits), F.lit(0))).alias(f"n_sigma{k}") for k in sigmas]
    return z.groupBy("ts").agg(F.avg("z").alias("mean_z"), *counts)


def replay(telemetry: DataFrame, channels: list[str], window: int = WINDOW, slide: int = SLIDE) -> DataFrame:
    """L1 and L2 errors of every window at machine-and-channel and machine level."""
    return profile_errors(telemetry, channels, ("L1", "L2"), window, slide)


def replay_fleet(errors: DataFrame) -> DataFrame:
    return errors.groupBy("win").agg(F.avg("l1").alias("l1"), F.avg("l2").alias("l2"))


def evaluate(
    test: DataFrame,
    channels: list[str],
    profile: DataFrame,
    window: int = WINDOW,
    slide: int = SLIDE,
) -> DataFrame:
    """Error, entropy and entropy-weighted error per machine and window of a scaled test table.

    The test table is scaled with the training scale and `profile` fitted on the training table
    (see plans.preparation).
    """
    errors = profile_window_errors(test, profile, channels, ("L1",), window, slide)
    entropy = window_entropy(test, channels, window, slide)
    return join_entropy(err_node(errors), entropy).withColumn("weighted", F.col("e") * F.col("entropy"))


def evaluate_fleet(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("ts").agg(F.avg("e").alias("mean_e"), F.avg("weighted").alias("mean_weighted"))

