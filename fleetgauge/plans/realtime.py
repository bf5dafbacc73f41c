"""Is the fleet, or a machine, abnormal right now?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.scalars import contribution
from fleetgauge.operators.errors import err_fleet, err_node, profile_window_errors
from fleetgauge.operators.grid import last_steps
from fleetgauge.operators.reconstruct import fit_profile
from fleetgauge.operators.rolling import long_short_diff
from fleetgauge.operators.scale import apply_scale, fit_scale
from fleetgauge.operators.windows import last_n_windows, last_window
from fleetgauge.schema import HISTORY_WINDOWS, LONG_MEAN, SHORT_MEAN_LIVE, WINDOW
from fleetgauge.session import written


def profile_errors(
    telemetry: DataFrame,
    channels: list[str],
    metrics: tuple[str, ...] = ("L1",),
    window: int = WINDOW,
    slide: int = 1,
    scale: DataFrame | None = None,
    profile: DataFrame | None = None,
    newest: int | None = None,
) -> DataFrame:
    """Scale, rebuild from the daily profile, measure windows.

    Scale and profile are fitted here only when none is handed in. With `newest`, only the steps
    the newest windows need go into the window stage.
    """
    scaled = apply_scale(telemetry, scale if scale is not None else fit_scale(telemetry, channels), channels)
    known = profile if profile is not None else fit_profile(scaled, channels)
    steps = scaled if newest is None else last_steps(scaled, (newest - 1) * slide + window)
    return profile_window_errors(steps, known, channels, metrics, window, slide)


def _judge(diffs: DataFrame, keys: list[str], digits: int | None) -> DataFrame:
    out = diffs.groupBy(*keys).agg(
        F.max_by("diff", "win").alias("last_diff"),
        F.avg("diff").alias("avg_diff"),
        F.stddev_pop("diff").alias("std_diff"),
        F.max_by("ts", "win").alias("as_of"),
    )
    size = F.abs(F.col("last_diff"))
    bound = F.col("avg_diff") + 2 * F.col("std_diff")
    if digits is not None:
        size, bound = F.round(size, digits), F.round(bound, digits)
    return out.withColumn("is_anomaly", size > bound)


def detect_fleet_last(
    errors: DataFrame,
    metric: str = "L1",
    windows: int = HISTORY_WINDOWS,
    long: int = LONG_MEAN,
    short: int = SHORT_MEAN_LIVE,
    trim: str = "tail",
    digits: int | None = None,
    newest: int | None = None,
) -> DataFrame:
    """One row: is the newest kept fleet difference beyond mean + 2 deviations?"""
    series = last_n_windows(err_fleet(errors, metric), windows, newest)
    return _judge(long_short_diff(series, [], "win", "e", long, short, trim), [], digits)


def detect_node_last(
    errors: DataFrame,
    metric: str = "L1",
    windows: int = HISTORY_WINDOWS,
    long: int = LONG_MEAN,
    short: int = SHORT_MEAN_LIVE,
    trim: str = "tail",
    digits: int | None = None,
    newest: int | None = None,
) -> DataFrame:
    series = last_n_windows(err_node(errors, metric), windows, newest)
    return _judge(long_short_diff(series, ["node"], "win", "e", long, short, trim), ["node"], digits)


def node_contribution(judged: DataFrame) -> DataFrame:
    """Signed newest difference per machine and its share of the fleet's sum."""
    total = judged.agg(F.sum("last_diff")).scalar()
    return judged.select("node", "last_diff", contribution("last_diff", total).alias("share"))


def top_contributors(contributions: DataFrame, k: int) -> DataFrame:
    return contributions.orderBy(F.desc("last_diff"), "node").limit(k)


def last_window_metrics(errors: DataFrame, channels: list[str], metric: str = "L1", last: int | None = None) -> DataFrame:
    """Newest window per machine: its error, one error per channel, and the fleet's total."""
    m = metric.lower()
    newest = last_window(errors, last)
    total = newest.agg(F.avg(m)).scalar()
    per_channel = [F.col(f"{m}_{c}").alias(f"channel_{k}_r_err") for k, c in enumerate(channels)]
    return newest.select("node", F.col(m).alias("r_err"), *per_channel, total.alias("total_r_err"))


def node_status(
    telemetry: DataFrame,
    channels: list[str],
    metric: str = "L1",
    window: int = WINDOW,
    windows: int = HISTORY_WINDOWS,
    long: int = LONG_MEAN,
    short: int = SHORT_MEAN_LIVE,
    trim: str = "tail",
    scale: DataFrame | None = None,
    profile: DataFrame | None = None,
    digits: int | None = None,
) -> DataFrame:
    """`node, r_err, is_anomaly`: what is published after each batch of readings."""
    errors, last = newest_errors(telemetry, channels, metric, window, windows, scale, profile)
    return status_of(errors, last, metric, windows, long, short, trim, digits)


def newest_errors(
    telemetry: DataFrame, channels: list[str], metric: str, window: int, windows: int, scale: DataFrame | None = None, profile: DataFrame | None = None
) -> tuple[DataFrame, int]:
    """Errors of the newest windows, written, and the number of the newest one."""
    last = telemetry.agg(F.max("i")).first()[0] - window + 1
    errors = profile_errors(telemetry, channels, (metric,), window, 1, scale, profile, newest=windows)
    return written(errors.select("node", "win", "ts", metric.lower()), "node-errors"), last


def status_of(
    errors: DataFrame, last: int, metric: str = "L1", windows: int = HISTORY_WINDOWS, long: int = LONG_MEAN, short: int = SHORT_MEAN_LIVE,
    trim: str = "tail", digits: int | None = None,
) -> DataFrame:
    """What `node_status` says of errors that are there, `last` being their newest window."""
    judged = detect_node_last(errors, metric, windows, long, short, trim, digits, last)
    newest = last_window(err_node(errors, metric), last).select("node", F.col("e").alias("r_err"))
    return newest.join(judged.select("node", "is_anomaly"), "node")
