"""Statistics of error series over machines and over time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.blocks import BLOCK, all_known, whole_starts, with_halo
from fleetgauge.functions.quantiles import percentiles
from fleetgauge.functions.scalars import ratio, threshold_ge, threshold_gt
from fleetgauge.operators.errors import err_fleet, err_node, err_node_channel
from fleetgauge.schema import SLIDE, WINDOW


def fleet_mean(errors: DataFrame) -> DataFrame:
    return errors.groupBy("ts").agg(F.avg("e").alias("mean_e"))


def fleet_median(errors: DataFrame, rank_error: float | None = None) -> DataFrame:
    """Exact, or off by at most `rank_error` of the machines in one pass (see `sketched_percentiles`)."""
    return percentiles(errors, ["ts"], "e", {"median_e": 0.5}, rank_error)


def working(e: Column | str = "e") -> Column:
    return F.coalesce(F.avg(F.when(F.col("cpus_alloc") > 0, F.col(e))), F.lit(0.0))


def working_mean(errors: DataFrame) -> DataFrame:
    """Mean over machines with allocated CPUs, 0 where there is none."""
    return errors.groupBy("ts").agg(working().alias("working_e"))


def join_alloc(errors: DataFrame, telemetry: DataFrame) -> DataFrame:
    return errors.join(telemetry.select("node", "ts", F.col("cpus_alloc").cast("int")), ["node", "ts"])


def join_names(metrics: DataFrame, names: DataFrame) -> DataFrame:
    return metrics.join(names, "node_no")


def join_entropy(errors: DataFrame, entropy: DataFrame) -> DataFrame:
    return errors.join(entropy, ["node", "win"])


def node_percentile(errors: DataFrame, percents: list[float], rank_error: float | None = None) -> DataFrame:
    """Exact, or off by at most `rank_error` of a machine's windows in one pass (see `sketched_percentiles`)."""
    return percentiles(errors, ["node"], "e", {f"p{p:g}": p / 100 for p in percents}, rank_error)


def node_mean_std(errors: DataFrame) -> DataFrame:
    return errors.groupBy("node").agg(F.avg("e").alias("mean_e"), F.stddev_pop("e").alias("std_e"))


def per_node_threshold(errors: DataFrame, limits: DataFrame, limit: str, digits: int | None = None) -> DataFrame:
    return errors.join(limits, "node").withColumn("flag", threshold_gt("e", limit, digits))


def zscore_time(errors: DataFrame) -> DataFrame:
    """Distance from the machine's own mean in its own deviations."""
    gap = F.abs(F.col("e") - F.col("mean_e"))
    return errors.join(node_mean_std(errors), "node").withColumn("z", ratio(gap, "std_e")).drop("mean_e", "std_e")


def zscore_nodes(errors: DataFrame) -> DataFrame:
    """Signed distance from the fleet's mean at the same step."""
    fleet = errors.groupBy("ts").agg(F.avg("e").alias("_m"), F.stddev_pop("e").alias("_s"))
    return errors.join(fleet, "ts").withColumn("z", ratio(F.col("e") - F.col("_m"), "_s")).drop("_m", "_s")


def node_limits(errors: DataFrame) -> DataFrame:
    return node_mean_std(errors).join(node_percentile(errors, [95, 90, 80]), "node")


def flagged(errors: DataFrame, digits: int | None = None) -> DataFrame:
    """The five outlier flags per machine and step."""
    z = ratio(F.abs(F.col("e") - F.col("mean_e")), "std_e")
    return errors.join(node_limits(errors), "node").select(
        *errors.columns,
        F.coalesce(threshold_gt(z, 2, digits), F.lit(0)).alias("z2"),
        F.coalesce(threshold_gt(z, 3, digits), F.lit(0)).alias("z3"),
        *[threshold_gt("e", f"p{p}", digits).alias(f"over{p}") for p in (95, 90, 80)],
    )


FLAGS = ["z2", "z3", "over95", "over90", "over80"]


def flag_counts(errors: DataFrame, digits: int | None = None) -> DataFrame:
    return flagged(errors, digits).groupBy("ts").agg(*[F.sum(f).alias(f"n_{f}") for f in FLAGS])


def fleet_flag_sum(errors: DataFrame, sigmas: tuple[int, ...] = (1, 2, 3), digits: int | None = None) -> DataFrame:
    z = zscore_nodes(errors)
    flags = [F.coalesce(threshold_ge("z", k, digits), F.lit(0)) for k in sigmas]
    return z.groupBy("ts").agg(*[F.sum(f).alias(f"n_sigma{k}") for k, f in zip(sigmas, flags)])


def aux_stats(errors: DataFrame, channels: list[str], metric: str = "L1") -> DataFrame:
    """Mean and deviation over windows per machine, per machine and channel, and of the fleet."""
    spread = [F.avg("e").alias("mean_e"), F.stddev_pop("e").alias("std_e")]
    none = F.lit(None).cast("string")
    per_node = err_node(errors, metric).groupBy("node").agg(*spread).withColumn("channel", none)
    per_channel = err_node_channel(errors, channels, metric).groupBy("node", "channel").agg(*spread)
    total = err_fleet(errors, metric).agg(*spread).withColumns({"node": none, "channel": none})
    out = per_node.unionByName(per_channel).unionByName(total)
    return out.select("node", "channel", "mean_e", "std_e")


def fleet_band(errors: DataFrame) -> DataFrame:
    """Median over machines with one sample deviation either way."""
    spread = errors.groupBy("ts").agg(F.stddev_samp("e").alias("_s"))
    m = F.col("median_e")
    return fleet_median(errors).join(spread, "ts").select(
        "ts", "median_e", (m - F.col("_s")).alias("lower"), (m + F.col("_s")).alias("upper")
    )


def _block_entropy(values: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Bits of the value distribution in each window of `window` rows starting at `starts`.

    A value enters the windows from `window` - 1 rows ahead of it and leaves after its own row. In order of value and
    row these entries and exits give its count in every window, each a change of the sum of c*log2(c). One sort
    serves all windows. The changes are whole numbers of a small unit, so they add up without drift.
    """
    rows, width = values.shape
    size = window * width
    codes = np.unique(values, return_inverse=True)[1].reshape(-1).astype(np.int64)
    at = np.repeat(np.arange(rows, dtype=np.int64), width)
    when = np.concatenate([np.maximum(at - window + 1, 0), at + 1])
    step = np.repeat(np.array([1, -1], dtype=np.int64), rows * width)
    order = np.argsort(np.concatenate([codes, codes]) * (rows + 1) + when, kind="stable")  # entries ahead of exits
    counts = np.arange(1, size + width + 1, dtype=float)
    unit = 2.0 ** (61 - np.ceil(np.log2(counts[-1] * (np.log2(counts[-1]) + 1))))
    part = np.concatenate([[0], np.rint(counts * np.log2(counts) * unit).astype(np.int64)])
    count = np.cumsum(step[order])
    change = np.zeros(rows + 1, dtype=np.int64)
    np.add.at(change, when[order], part[count] - part[count - step[order]])
    weight = np.cumsum(change)[starts] / unit
    return np.maximum(np.log2(size) - weight / size, 0.0)


def window_entropy(
    df: DataFrame, channels: list[str], window: int = WINDOW, slide: int = SLIDE, block: int = BLOCK
) -> DataFrame:
    """Shannon entropy of the distinct values of all channels in each window.

    Counting values per window in SQL needs a row per (window, step, channel); here a task sees
    one bounded block of steps and returns one row per window. Windows that lack a step, or a value
    in any channel, are left out.
    """

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        steps = pdf["i"].to_numpy()
        values = pdf[channels].to_numpy(dtype=float)
        starts = whole_starts(steps, pdf["_known"].to_numpy(), steps // block == pdf["_blk"].iloc[0], window, slide)
        wins = (steps[starts] // slide).astype("int32")
        return pd.DataFrame(
            {"node": pdf["node"].iloc[0], "win": wins, "entropy": _block_entropy(values, starts, window)}
        )

    parts = with_halo(df.select("node", "i", *channels, all_known(channels).alias("_known")), "i", window - 1, block)
    return parts.groupBy("node", "_blk").applyInPandas(score, "node string, win int, entropy double")


def entropy_weighted_error(errors: DataFrame, entropy: DataFrame) -> DataFrame:
    """Fleet mean of entropy times error per window."""
    both = join_entropy(errors, entropy).withColumn("weighted", F.col("entropy") * F.col("e"))
    return both.groupBy("ts").agg(F.avg("weighted").alias("weighted_e"))
