"""Min-max scaling per channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.scalars import denormalize as _up
from fleetgauge.functions.scalars import normalize as _down


def fit_scale(df: DataFrame, channels: list[str]) -> DataFrame:
    """`(channel, mn, mx)` over all machines and steps."""
    extremes = [f(c).alias(f"{c}_{n}") for c in channels for n, f in (("mn", F.min), ("mx", F.max))]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("channel"),
                F.col(f"{c}_mn").cast("double").alias("mn"),
                F.col(f"{c}_mx").cast("double").alias("mx"),
            )
            for c in channels
        ]
    )
    return df.agg(*extremes).select(F.inline(rows))


def _limits(scale: DataFrame, channels: list[str]) -> dict[str, tuple[Column, Column]]:
    """Low and high per channel as literals; the table has one row per channel."""
    rows = {row.channel: row for row in scale.where(F.col("channel").isin(channels)).collect()}
    return {c: tuple(F.lit(x).cast("double") for x in (rows[c].mn, rows[c].mx)) for c in channels}


def apply_scale(df: DataFrame, scale: DataFrame, channels: list[str]) -> DataFrame:
    limits = _limits(scale, channels)
    return df.withColumns({c: _down(c, *limits[c]) for c in channels})


def revert_scale(df: DataFrame, scale: DataFrame, channels: list[str]) -> DataFrame:
    limits = _limits(scale, channels)
    return df.withColumns({c: _up(c, *limits[c]) for c in channels})


def join_scale(long: DataFrame, scale: DataFrame) -> DataFrame:
    """Scale values kept as `(…, channel, x)` rows; one scale row per channel."""
    joined = long.join(F.broadcast(scale), "channel")
    return joined.withColumn("x", _down("x", F.col("mn"), F.col("mx"))).drop("mn", "mx")


def to_long(df: DataFrame, ids: list[str], channels: list[str], value: str = "x") -> DataFrame:
    return df.unpivot(ids, channels, "channel", value)


def to_wide(df: DataFrame, ids: list[str], names: list[str], key: str = "channel", value: str = "x") -> DataFrame:
    return df.groupBy(*ids).pivot(key, names).agg(F.first(value))
