"""Dense numbering of a globally sorted table without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetgauge.session import checkpoint

_BITS = 33  # monotonically_increasing_id keeps the partition number above these bits


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """0-based position of each row in the order. Ties must not occur in `order`."""
    placed = checkpoint(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", _BITS)
    sizes = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    # One row per partition of the sorted data: bounded by the partition count.
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    return (
        placed.withColumn("_p", part)
        .join(F.broadcast(starts), "_p")
        .withColumn(name, (F.col("_start") + F.col("_m") - F.shiftleft("_p", _BITS)).cast("int"))
        .drop("_p", "_m", "_start")
    )
