"""Telemetry laid out from the test tables: a machine per user of `events`, hourly steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.operators.grid import cast_channels, time_grid
from fleetgauge.plans.realtime import profile_errors
from fleetgauge.schema import CHANNELS
from fleetgauge.session import written

HOUR = 3600
DIGITS = 9  # precision at which bounds are compared


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """One row per machine and hour with any event. Sums of whole cents keep the means exact."""
    k = F.get_json_object("props", "$.k").cast("long")
    cents = F.round(F.col("value") * 100).cast("long")
    return (
        events(spark, sf)
        .groupBy(
            F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("node"),
            F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"),
        )
        .agg(
            (F.sum(cents) / (100 * F.count("*"))).alias("power"),
            (F.sum(k) / F.count("*")).alias("cpu1"),
            F.max("value").alias("cpu2"),
            F.count("*").alias("cpus_alloc"),
        )
    )


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    span = events(spark, sf).agg(F.min("ts").cast("timestamp").alias("a"), F.max("ts").cast("timestamp").alias("b"))
    bounds = span.select(F.date_trunc("hour", "a").alias("start_ts"), F.date_trunc("hour", "b").alias("end_ts"))
    grid = time_grid(readings(spark, sf), CHANNELS, HOUR, fill=0.0, bounds=bounds)
    return cast_channels(grid, {"cpus_alloc": "int"})


def faulty(spark: SparkSession, sf: str) -> DataFrame:
    """Telemetry with faults put in: two for the whole fleet, one late for every 16th machine."""
    i, user = F.col("i"), F.substring("node", 2, 6).cast("int")
    wrong = i.between(150, 155) | i.between(360, 369) | ((user % 16 == 3) & i.between(700, 719))
    extra = F.when(wrong, 400.0).otherwise(0.0)
    df = telemetry(spark, sf)
    return written(df.withColumns({c: F.col(c) + extra for c in ("power", "cpu1", "cpu2")}), "telemetry")


def errors(spark: SparkSession, sf: str, window: int = 60, metrics: tuple[str, ...] = ("L1",)) -> DataFrame:
    return written(profile_errors(faulty(spark, sf), CHANNELS, metrics, window), "errors")


def incidents(spark: SparkSession) -> DataFrame:
    """Known incidents: the three put-in faults, a quiet spell, one reaching out of the span."""
    return spark.sql(
        """SELECT * FROM VALUES
        (1, 'fleet burst', 3, TIMESTAMP '2024-01-07 06:00:00', TIMESTAMP '2024-01-07 11:00:00', array('power')),
        (2, 'fleet heat', 4, TIMESTAMP '2024-01-16 00:00:00', TIMESTAMP '2024-01-16 09:00:00', array('power','temp')),
        (3, 'late fault', 2, TIMESTAMP '2024-01-20 04:00:00', TIMESTAMP '2024-01-20 23:00:00', array('power')),
        (4, 'quiet', 1, TIMESTAMP '2024-01-11 02:00:00', TIMESTAMP '2024-01-11 05:00:00', array('none')),
        (5, 'outside', 1, TIMESTAMP '2024-01-30 20:00:00', TIMESTAMP '2024-02-02 00:00:00', array('none'))
        AS t(id, description, severity, date_start, date_end, tags)"""
    )


def event_incidents(spark: SparkSession, sf: str) -> DataFrame:
    """Error events as incident rows with times as text; they last as many minutes as `k` says."""
    k = F.get_json_object("props", "$.k").cast("int")
    start = F.date_trunc("second", F.col("ts").cast("timestamp"))
    end = F.timestamp_add("MINUTE", k, start)
    text = "yyyy-MM-dd HH:mm:ss"
    return events(spark, sf).where(F.col("event_type") == "error").select(
        F.col("event_id").cast("int").alias("id"),
        F.concat(F.lit("error of user "), F.col("user_id").cast("string")).alias("description"),
        (k % 5).alias("severity"),
        F.date_format(start, text).alias("date_start"),
        F.date_format(end, text).alias("date_end"),
        F.array("event_type", F.col("user_id").cast("string")).alias("tags"),
    )


def series(spark: SparkSession, sf: str) -> DataFrame:
    """One vector per machine stand-in: `id, v, label`."""
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label"
    )


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Output form of every check: doubles rounded, times without zone."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)
