"""Intervals of time in dyadic buckets: one of any length is about 2*log2(length) rows.

Time is cut into buckets of `grain` seconds, and buckets are put together by twos, fours, eights. An interval is the few
largest of these that make it up, and a moment lies in exactly one bucket of each level, so an equi-join
of the two finds every interval around a moment once. Both ends of an interval belong to it; one without a start or an end, or whose
end lies before its start, holds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetgauge.session import written

GRAIN = 3600


def bucket(ts: str | Column, grain: int = GRAIN) -> Column:
    """Number of the bucket a time lies in."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts) / F.lit(grain * 1_000_000))


def _up(x: Column, level: Column) -> Column:
    """x / 2^level, rounded down; Spark's function takes no column for the places."""
    return F.call_function("shiftright", x, level)


def cover(intervals: DataFrame, first: Column, last: Column) -> DataFrame:
    """Add `_level, _at`: a row for each of the dyadic buckets that make up the buckets first .. last, both included."""
    n = last - first + 1
    held = intervals.withColumns({"_f": first.cast("long"), "_l": last.cast("long")}).where(n > 0)
    levels = F.floor(F.log2(F.col("_l") - F.col("_f") + 1)).cast("int")
    held = held.withColumn("_level", F.explode(F.sequence(F.lit(0), levels)))
    # What is left at a level after those below took an odd bucket off either end.
    low, high = -_up(-F.col("_f"), F.col("_level")), _up(F.col("_l") + 1, F.col("_level"))
    held = held.withColumns({"_lo": low, "_hi": high}).where(F.col("_lo") < F.col("_hi"))
    odd_low, odd_high = F.col("_lo").bitwiseAND(F.lit(1)) == 1, F.col("_hi").bitwiseAND(F.lit(1)) == 1
    left = F.when(odd_low, F.col("_lo"))
    right = F.when(odd_high & (F.col("_hi") - 1 >= F.when(odd_low, F.col("_lo") + 1).otherwise(F.col("_lo"))), F.col("_hi") - 1)
    out = held.withColumn("_at", F.explode(F.array_compact(F.array(left, right))))
    return out.drop("_f", "_l", "_lo", "_hi")


def ancestors(df: DataFrame, at: Column, levels: Column) -> DataFrame:
    """Add `_level, _at`: a row for each dyadic bucket of levels 0 .. `levels` around the bucket `at`."""
    out = df.withColumn("_at", at.cast("long")).withColumn("_level", F.explode(F.sequence(F.lit(0), levels)))
    return out.withColumn("_at", _up(F.col("_at"), F.col("_level")))


def around(
    points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, keys: list[str] | None = None, grain: int = GRAIN
) -> DataFrame:
    """Points next to every interval whose `start` .. `end` holds their time `at`; with `keys`, only where these are equal.

    Other columns of the two sides have names of their own. A point is a row per level, up to the longest interval's.
    """
    keys = keys or []
    covered = cover(intervals, bucket(start, grain), bucket(end, grain))
    # The longest interval sets the levels; none at all, and no point is laid out.
    top = intervals.agg(F.coalesce(F.max(F.floor(F.log2(bucket(end, grain) - bucket(start, grain) + 1))), F.lit(0)).cast("int")).scalar()
    laid = ancestors(points.where(F.col(at).isNotNull()), bucket(at, grain), top)
    joined = laid.join(covered, [*keys, "_level", "_at"])
    return joined.where(F.col(at).between(F.col(start), F.col(end))).drop("_level", "_at")


def overlapping(
    left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], grain: int = GRAIN
) -> DataFrame:
    """Pairs of intervals that share a moment, each once: one begins inside the other, or both at the same moment."""
    (a, b), (c, d) = left_ends, right_ends
    proper_left, proper_right = left.where(F.col(a) <= F.col(b)), right.where(F.col(c) <= F.col(d))
    inside = around(proper_left, a, proper_right, c, d, grain=grain)
    behind = around(proper_right, c, proper_left, a, b, grain=grain).where(F.col(c) > F.col(a))
    columns = [*left.columns, *right.columns]
    return inside.select(*columns).unionByName(behind.select(*columns))


def overlap_totals(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], by: str, first: str) -> DataFrame:
    """Per value of the left column `by`: how many pairs `overlapping` gives, `n`, and the earliest start `first` of a right interval in them.

    No pair is laid out: a left interval meets all right ones that begin by its end, but for those that end before its start.
    So starts, ends and the two ends of the left intervals are put in order of time, and running counts tell the rest.
    """
    (a, b), (c, d) = left_ends, right_ends
    proper_left, proper_right = left.where(F.col(a) <= F.col(b)), right.where(F.col(c) <= F.col(d))
    none, kind_of = F.lit(None), left.schema[by].dataType

    def points(side: DataFrame, t: str, kind: int, name: Column, start: Column, until: Column) -> DataFrame:
        at = [F.col(t).cast("timestamp").alias("_t"), F.lit(kind).alias("_kind"), name.cast(kind_of).alias("_by")]
        return side.select(*at, start.cast("timestamp").alias("_c"), until.cast("timestamp").alias("_hi"), F.rand(0).alias("_x"))

    # Of one moment: starts, starts and ends of left intervals, ends.
    laid = points(proper_right, c, 0, none, none, none).unionByName(points(proper_left, a, 1, F.col(by), none, F.col(b)))
    laid = laid.unionByName(points(proper_left, b, 2, F.col(by), none, none)).unionByName(points(proper_right, d, 3, none, F.col(c), none))
    placed = written(laid.orderBy("_t", "_kind", "_x").withColumn("_p", F.spark_partition_id()), "moments")
    begun, ended = (F.col("_kind") == 0).cast("long"), (F.col("_kind") == 3).cast("long")
    parts = placed.groupBy("_p").agg(F.sum(begun).alias("_bn"), F.sum(ended).alias("_en"), F.min("_c").alias("_c"))
    # A row per partition of the sorted data.
    order = W.orderBy("_p")
    ahead, behind = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    rest = parts.select("_p", F.sum("_bn").over(ahead).alias("_b0"), F.sum("_en").over(ahead).alias("_e0"), F.min("_c").over(behind).alias("_c0"))
    inside = W.partitionBy("_p").orderBy("_t", "_kind", "_x")
    back = W.partitionBy("_p").orderBy(F.desc("_t"), F.desc("_kind"), F.desc("_x"))  # a frame to the end is done anew for each row
    so_far, from_here = (order.rowsBetween(W.unboundedPreceding, W.currentRow) for order in (inside, back))
    counted = placed.withColumns({"_bn": F.sum(begun).over(so_far), "_en": F.sum(ended).over(so_far), "_cn": F.min("_c").over(from_here)})
    counted = counted.where(F.col("_kind").isin(1, 2)).join(F.broadcast(rest), "_p")
    n = F.when(F.col("_kind") == 2, F.col("_bn") + F.coalesce("_b0", F.lit(0))).otherwise(-F.col("_en") - F.coalesce("_e0", F.lit(0)))
    earliest = F.least("_cn", "_c0")
    out = counted.groupBy(F.col("_by").alias(by)).agg(F.sum(n).alias("n"), F.min(F.when(earliest <= F.col("_hi"), earliest)).alias(first))
    return out.where(F.col("n") > 0)


def outside(
    df: DataFrame, periods: DataFrame, start: str = "start_ts", end: str = "end_ts", ts: str = "ts",
    keys: list[str] | None = None, grain: int = GRAIN,
) -> DataFrame:
    """Rows whose time lies in no period (of their own keys, if any are named). Rows without a time stay.

    With keys, rows and starts of periods lie in order of time in blocks of their keys, and a row goes when the latest end
    so far is not ahead of it; each row is sent once. Without keys rows are not multiplied: only the distinct buckets they lie in meet the dyadic buckets of the periods. Rows of a
    bucket that some period holds from end to end go by an anti join on the bucket; the rest meet the at most
    two ragged ends of each period, put together per bucket so that none overlap.
    """
    if keys:
        return _outside_own(df, periods, start, end, ts, keys, grain)
    keys = []
    micros = F.lit(grain * 1_000_000)
    spans = periods.select(*keys, F.unix_micros(F.col(start).cast("timestamp")).alias("_s"), F.unix_micros(F.col(end).cast("timestamp")).alias("_e"))
    spans = spans.where(F.col("_s") <= F.col("_e"))
    first, last = F.floor((F.col("_s") + micros - 1) / micros), F.floor((F.col("_e") + 1) / micros) - 1
    spans = spans.withColumns({"_first": first.cast("long"), "_last": last.cast("long")})
    whole = cover(spans, F.col("_first"), F.col("_last")).select(*keys, "_level", "_at").distinct()
    top = spans.agg(F.coalesce(F.max(F.floor(F.log2(F.greatest(F.col("_last") - F.col("_first") + 1, F.lit(1))))), F.lit(0)).cast("int")).scalar()
    placed = df.withColumn("_b", bucket(ts, grain))
    used = placed.where(F.col("_b").isNotNull()).select(*keys, "_b").distinct()
    gone = ancestors(used, F.col("_b"), top).join(whole, [*keys, "_level", "_at"], "left_semi").select(*keys, "_b").distinct()

    begin, stop = F.floor(F.col("_s") / micros), F.floor(F.col("_e") / micros)
    edges = spans.withColumn("_b", F.explode(F.array_distinct(F.array(begin, stop))))
    edges = edges.where((F.col("_b") < F.col("_first")) | (F.col("_b") > F.col("_last")))
    order = W.partitionBy(*keys, "_b").orderBy("_s", "_e")
    seen = F.max("_e").over(order.rowsBetween(W.unboundedPreceding, -1))
    merged = (
        edges.withColumn("_fresh", (seen.isNull() | (seen < F.col("_s"))).cast("int"))
        .withColumn("_isle", F.sum("_fresh").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .groupBy(*keys, "_b", "_isle").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
        .select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col("_b").alias("_eb"), "_s", "_e")
    )
    on = (F.col("_b") == F.col("_eb")) & F.unix_micros(F.col(ts).cast("timestamp")).between(F.col("_s"), F.col("_e"))
    for n, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_k{n}"))
    return placed.join(gone, [*keys, "_b"], "left_anti").join(merged, on, "left_anti").select(*df.columns)


_SPAN = 1024  # buckets in a block of time
_LONG = 64  # blocks of a period from which on it pays to look up the time the rows span


def _outside_own(df: DataFrame, periods: DataFrame, start: str, end: str, ts: str, keys: list[str], grain: int) -> DataFrame:
    micros = grain * 1_000_000 * _SPAN
    spans = periods.select(*keys, F.unix_micros(F.col(start).cast("timestamp")).alias("_s"), F.unix_micros(F.col(end).cast("timestamp")).alias("_e"))
    for k in keys:
        spans = spans.where(F.col(k).isNotNull())  # a row without a key has no period
    spans = spans.where(F.col("_s") <= F.col("_e"))
    order = W.partitionBy(*keys).orderBy("_s", "_e")
    seen = F.max("_e").over(order.rowsBetween(W.unboundedPreceding, -1))
    # A period inside those ahead of it adds nothing, another one only what lies behind their end.
    spans = spans.withColumn("_m", seen).where(F.col("_m").isNull() | (F.col("_e") > F.col("_m")))
    spans = spans.withColumn("_s", F.greatest("_s", F.col("_m") + 1)).drop("_m")
    first, last = F.floor(F.col("_s") / micros), F.floor(F.col("_e") / micros)
    longest = spans.agg(F.max(last - first)).first()[0]
    if longest is not None and longest > _LONG:
        at = F.unix_micros(F.col(ts).cast("timestamp"))
        low, high = df.agg(F.floor(F.min(at) / micros), F.floor(F.max(at) / micros)).first()
        if low is None:
            return df
        first, last = F.greatest(first, F.lit(low)), F.least(last, F.lit(high))
        spans = spans.where(first <= last)
    spans = spans.withColumn("_blk", F.explode(F.sequence(first, last)))
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumns({"_t": at, "_kind": F.lit(1), "_e": F.lit(None).cast("long"), "_blk": F.floor(at / micros)})
    ends = spans.select(
        *keys, *[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name not in keys],
        F.col("_s").alias("_t"), F.lit(0).alias("_kind"), "_e", "_blk",
    )
    laid = rows.unionByName(ends)
    so_far = W.partitionBy(*keys, "_blk").orderBy("_t", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    held = laid.withColumn("_e", F.max("_e").over(so_far)).where((F.col("_kind") == 1) & (F.col("_e").isNull() | (F.col("_e") < F.col("_t"))))
    return held.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in df.schema.fields])
