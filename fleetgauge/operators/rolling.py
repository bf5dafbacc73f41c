"""Padded moving averages and their difference.

Widths are steps. A step without a row or without a value counts as the overall mean of its series, be
it ahead of the start or in a gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.blocks import BLOCK, trailing_sums

TRIMS = ("tail", "warmup")


def _with_stats(df: DataFrame, keys: list[str], pos: str, column: str) -> DataFrame:
    stats = df.groupBy(*keys).agg(
        F.avg(column).alias("_avg"), F.max(pos).alias("_last"), F.min(pos).alias("_first")
    )
    if keys:
        return df.join(stats, keys)
    one = stats.first()  # a single series: one row
    return df.withColumns({c: F.lit(one[c]) for c in ("_avg", "_last", "_first")})


def _padded(df: DataFrame, keys: list[str], pos: str, column: str, widths: dict[str, int], block: int) -> DataFrame:
    sums = trailing_sums(_with_stats(df, keys, pos, column), keys, pos, [column], sorted(set(widths.values())), block=block)
    means = {
        name: (F.col(f"{column}_s{w}") + (w - F.col(f"{column}_n{w}")) * F.col("_avg")) / w
        for name, w in widths.items()
    }
    return sums.select(*df.columns, "_last", "_first", *[m.alias(n) for n, m in means.items()])


def rolling_mean(
    df: DataFrame, keys: list[str], pos: str, column: str, width: int, name: str = "m", block: int = BLOCK
) -> DataFrame:
    """Mean of the last `width` steps."""
    return _padded(df, keys, pos, column, {name: width}, block).drop("_last", "_first")


def long_short_diff(
    df: DataFrame,
    keys: list[str],
    pos: str,
    column: str,
    long: int,
    short: int,
    trim: str = "tail",
    block: int = BLOCK,
) -> DataFrame:
    """`m_long`, `m_short` and `diff` = short - long, `long` steps of each series left out.

    trim='tail' leaves out the newest rows, trim='warmup' the oldest ones, whose long mean is
    still mostly padding.
    """
    if trim not in TRIMS:
        raise ValueError(f"trim must be one of {TRIMS}")
    both = _padded(df, keys, pos, column, {"m_long": long, "m_short": short}, block)
    kept = F.col(pos) <= F.col("_last") - long if trim == "tail" else F.col(pos) >= F.col("_first") + long
    return both.where(kept).drop("_last", "_first").withColumn("diff", F.col("m_short") - F.col("m_long"))
