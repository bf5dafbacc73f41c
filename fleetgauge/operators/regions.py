"""Abnormal periods as rows, and their comparison with known incidents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetgauge.functions.blocks import BLOCK
from fleetgauge.operators.intervals import overlapping


def regions(flags: DataFrame, keys: list[str], pos: str = "win", flag: str = "flag", block: int = BLOCK) -> DataFrame:
    """Maximal runs of consecutive flagged steps: first and last step (both included) and times.

    Runs are built per block of steps; only runs that touch a block border, at most two per
    block, are then put together across blocks.
    """
    on = flags.where(F.col(flag) == 1).withColumn("_blk", F.floor(F.col(pos) / block))
    inside = W.partitionBy(*keys, "_blk").orderBy(pos)
    runs = (
        on.withColumn("_isle", F.col(pos) - F.row_number().over(inside))
        .groupBy(*keys, "_blk", "_isle")
        .agg(
            F.min(pos).alias("first_step"),
            F.max(pos).alias("last_step"),
            F.min("ts").alias("start_ts"),
            F.max("ts").alias("end_ts"),
        )
        .drop("_blk", "_isle")
    )
    border = (F.col("first_step") % block == 0) | (F.col("last_step") % block == block - 1)
    along = (W.partitionBy(*keys) if keys else W).orderBy("first_step")
    fresh = F.col("first_step") != F.coalesce(F.lag("last_step").over(along), F.lit(-2)) + 1
    joined = (
        runs.where(border)
        .withColumn("_new", fresh.cast("int"))
        .withColumn("_run", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .groupBy(*keys, "_run")
        .agg(
            F.min("first_step").alias("first_step"),
            F.max("last_step").alias("last_step"),
            F.min("start_ts").alias("start_ts"),
            F.max("end_ts").alias("end_ts"),
        )
        .drop("_run")
    )
    return runs.where(~border).unionByName(joined)


def truth_in_range(incidents: DataFrame, span: DataFrame) -> DataFrame:
    """Incidents that lie wholly inside the analysed span (`start_ts`, `end_ts`, one row)."""
    low, high = span.select("start_ts").scalar(), span.select("end_ts").scalar()
    return incidents.where((F.col("date_start") >= low) & (F.col("date_end") <= high))


def match_regions(found: DataFrame, incidents: DataFrame) -> DataFrame:
    """Overlapping (region, incident) pairs, whatever their lengths; see `intervals`."""
    return overlapping(found, incidents, ("start_ts", "end_ts"), ("date_start", "date_end"))


def regions_vs_truth(found: DataFrame, incidents: DataFrame) -> DataFrame:
    """`detected` pairs, `missed` incidents and `false_alarm` regions.

    Further columns of `found` (the machine, the bound) tell regions apart and come along; an incident
    is missed when no region at all meets it.
    """
    pairs = match_regions(found, incidents)
    region = [*(c for c in found.columns if c not in ("first_step", "last_step", "start_ts", "end_ts")),
              "first_step", "last_step", "start_ts", "end_ts"]
    truth = ["id", "date_start", "date_end"]
    hit = pairs.select(F.lit("detected").alias("outcome"), *region, *truth)
    missed = incidents.join(pairs.select("id").distinct(), "id", "left_anti")
    met = pairs.select(*[F.col(c).alias(f"_{c}") for c in region]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in region])
    alarm = found.join(met, same, "left_anti")
    return (
        hit.unionByName(missed.select(F.lit("missed").alias("outcome"), *truth), allowMissingColumns=True)
        .unionByName(alarm.select(F.lit("false_alarm").alias("outcome"), *region), allowMissingColumns=True)
    )
