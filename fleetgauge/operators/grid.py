"""Step axis of the telemetry: regular grid, alignment checks, step counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetgauge.functions.blocks import BLOCK
from fleetgauge.functions.numbering import number_rows


def node_index(df: DataFrame) -> DataFrame:
    """Machines in name order with a dense 0-based number."""
    return number_rows(df.select("node").distinct(), ["node"], "node_no")


def dates_range(df: DataFrame) -> DataFrame:
    """First and last timestamp over all machines, one row."""
    return df.agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


def step_of(ts: Column, start: Column, seconds: int) -> Column:
    return F.floor((F.unix_timestamp(ts) - F.unix_timestamp(start)) / seconds).cast("int")


def time_grid(
    readings: DataFrame,
    channels: list[str],
    seconds: int = 60,
    fill: float | None = None,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """Every machine at every step from the first to the last reading: node, ts, i, channels.

    Of several readings within one step the newest counts (of equal times that with the greatest
    values). The two ends of the
    axis are read first (one row, or the caller's `bounds`). Each machine has a mark at the start of every span;
    marks and readings lie by (node, span) in step order, and each unfolds into the steps up to the next one. So
    the unfolded steps are never shuffled, sorted, joined nor sent to all tasks.
    """
    if bounds is None:
        bounds = dates_range(readings)
    first, steps = bounds.select(
        F.unix_timestamp("start_ts"), step_of(F.col("end_ts"), F.col("start_ts"), seconds)
    ).first()
    if steps is None:
        return readings.select("node", "ts", F.lit(0).alias("i"), *channels)
    start, last = F.timestamp_seconds(F.lit(first)), F.lit(steps)
    span = BLOCK
    step = step_of(F.col("ts"), start, seconds)
    values = readings.select("node", F.floor(step / span).cast("int").alias("_b"), step.alias("i"), "ts", *channels)
    values = values.where(F.col("node").isNotNull() & F.col("i").between(F.lit(0), last))
    # Readings of one step meet before anything moves, so many readings in few steps are no heavy key.
    values = values.groupBy("node", "_b", "i").agg(F.max(F.struct("ts", *channels)).alias("_v"))
    marks = readings.select("node").distinct().select("node", F.explode(F.sequence(F.lit(0), F.lit(steps // span))).alias("_b"))
    marks = marks.select("node", "_b", (F.col("_b") * span).alias("i"), F.lit(None).cast(values.schema["_v"].dataType).alias("_v"))
    laid = values.unionByName(marks).repartition("node", "_b")
    order = W.partitionBy("node", "_b").orderBy("i", F.col("_v").isNull())
    end = F.least((F.col("_b") + 1) * span - 1, last)
    until = F.coalesce(F.lead("i").over(order) - 1, end)
    # A mark that follows a reading of its own step stands for the steps behind it, the reading for its own.
    begin = F.col("i") + F.coalesce(F.lag("i").over(order) == F.col("i"), F.lit(False)).cast("int")
    until = F.when(F.col("_v").isNull(), until).otherwise(F.greatest(until, "i"))
    out = laid.withColumns({"_from": begin, "_until": until}).where(F.col("_from") <= F.col("_until"))
    out = out.select("node", "_v", F.col("i").alias("_at"), F.explode(F.sequence("_from", "_until")).alias("i"))
    ts = F.timestamp_seconds(F.lit(first) + F.col("i").cast("long") * seconds)
    held = [F.when(F.col("i") == F.col("_at"), F.col(f"_v.{c}")) for c in channels]
    filled = [(x if fill is None else F.coalesce(x, F.lit(fill))).alias(c) for x, c in zip(held, channels, strict=True)]
    return out.select("node", ts.alias("ts"), "i", *filled)


def cast_channels(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})


def step_counts(df: DataFrame) -> DataFrame:
    """Number of steps per machine."""
    return df.groupBy("node").agg((F.max("i") + 1).alias("steps"))


def head_steps(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("i") < n)


def drop_head(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("i") >= n)


def truncate_to_slide(df: DataFrame, slide: int) -> DataFrame:
    """Cut the tail of each machine so that its step count is a multiple of the slide."""
    kept = step_counts(df).select("node", (F.col("steps") - F.col("steps") % slide).alias("_keep"))
    return df.join(kept, "node").where(F.col("i") < F.col("_keep")).drop("_keep")


def check_aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """Machines missing on one side or with different step counts; empty when aligned."""
    a = left.groupBy("node").agg(F.count("*").alias("left_steps"))
    b = right.groupBy("node").agg(F.count("*").alias("right_steps"))
    both = a.join(b, "node", "full_outer").na.fill(0, ["left_steps", "right_steps"])
    return both.where(F.col("left_steps") != F.col("right_steps"))


def same_index(left: DataFrame, right: DataFrame) -> DataFrame:
    """Machine names on one side only; empty when the two sets agree."""
    a, b = left.select("node").distinct(), right.select("node").distinct()
    return (
        a.join(b, "node", "left_anti")
        .withColumn("side", F.lit("left"))
        .unionByName(b.join(a, "node", "left_anti").withColumn("side", F.lit("right")))
    )


def window_count(df: DataFrame, window: int, slide: int) -> DataFrame:
    steps = step_counts(df)
    n = F.floor((F.col("steps") - window) / slide) + 1
    return steps.select("node", F.greatest(n, F.lit(0)).alias("windows"))


def usable_length(df: DataFrame, window: int, slide: int) -> DataFrame:
    """Usable and full window counts per machine, and whether the step count fits the slide."""
    room = F.col("steps") - window
    return step_counts(df).select(
        "node",
        "steps",
        F.ceil(room / slide).alias("usable"),
        F.floor(F.col("steps") / slide).alias("full"),
        (F.col("steps") % slide != 0).alias("misfit"),
    )


def append_batch(history: DataFrame, batch: DataFrame) -> DataFrame:
    return history.unionByName(batch)


def union_nodes(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def history_window(df: DataFrame, hours: int = 24) -> DataFrame:
    """Readings of the newest `hours`, counted back from the newest timestamp."""
    newest = df.agg(F.max("ts")).scalar()
    return df.where(F.col("ts") > newest - F.make_interval(hours=F.lit(hours)))


def last_steps(df: DataFrame, n: int) -> DataFrame:
    """Newest n steps of the common axis."""
    newest = df.agg(F.max("i")).scalar()
    return df.where(F.col("i") > newest - n)
