"""Choosing rows and columns. Lists from the settings become literals, so they reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.quantiles import exact_percentiles
from fleetgauge.operators.intervals import outside


def select_channels(df: DataFrame, channels: list[str]) -> DataFrame:
    return df.select("node", "ts", *[c for c in df.columns if c == "i"], *channels)


def filter_host(df: DataFrame, hosts: list[str]) -> DataFrame:
    return df.where(F.col("node").isin(hosts))


def absent_hosts(df: DataFrame, hosts: list[str]) -> DataFrame:
    """Those of the asked-for names that have no row."""
    asked = df.sparkSession.createDataFrame([(h,) for h in hosts], "node string")
    seen = filter_host(df, hosts).select("node").distinct()
    return asked.join(seen, "node", "left_anti")


def date_range_filter(df: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Both days included."""
    start = F.lit(first_day).cast("timestamp")
    stop = F.date_add(F.lit(last_day).cast("date"), 1).cast("timestamp")
    return df.where((F.col("ts") >= start) & (F.col("ts") < stop))


def _inside(periods: list[tuple[str, str]]) -> Column:
    spans = [
        (F.col("ts") >= F.lit(a).cast("timestamp")) & (F.col("ts") <= F.lit(b).cast("timestamp"))
        for a, b in periods
    ]
    return reduce(lambda x, y: x | y, spans, F.lit(False))


def remove_periods(df: DataFrame, periods: list[tuple[str, str]]) -> DataFrame:
    return df.where(~_inside(periods)) if periods else df


def remove_period_table(df: DataFrame, periods: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """`remove_periods` for periods as rows `start_ts, end_ts` (both ends removed too), of any number and length.

    With `keys` (such as the machine) a period holds only for rows with the same keys.
    """
    return outside(df, periods, keys=keys)


def hosts_blacklist(df: DataFrame, hosts: list[str]) -> DataFrame:
    return df.where(~F.col("node").isin(hosts)) if hosts else df


def top_nodes(df: DataFrame, n: int = 200, score: Column | None = None) -> DataFrame:
    """Rows of the n machines with the highest score (default: total power)."""
    ranked = df.groupBy("node").agg((score if score is not None else F.sum("power")).alias("_score"))
    best = ranked.orderBy(F.desc("_score"), "node").limit(n).select("node")
    return df.join(best, "node", "left_semi")


def active_nodes(df: DataFrame, floor: float = 0.001) -> DataFrame:
    """Machines that ever drew power, with the number of such readings."""
    busy = df.where(F.col("power") > floor)
    return busy.groupBy("node").agg(F.count("*").alias("active_steps"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles, a row per column."""
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "channel", "x")
    basic = long.groupBy("channel").agg(
        F.count("x").alias("n"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    quartiles = exact_percentiles(long, ["channel"], "x", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return basic.join(quartiles, "channel").select(
        "channel", "n", "mean", "std", "min", "q25", "q50", "q75", "max"
    )
