"""Shared names, defaults and row types."""

from __future__ import annotations

from pyspark.sql import types as T

# Channel names and analysis settings every pipeline starts from.
CHANNELS = ["power", "cpu1", "cpu2", "cpus_alloc"]
WINDOW = 60
SLIDE = 1
LONG_MEAN = 180
SHORT_MEAN_LIVE = 60
SHORT_MEAN_EVAL = 30
HISTORY_WINDOWS = 360
SIGMAS = [1.0, 2.0, 2.5, 3.0, 4.0]
TS_TEXT = "yyyy-MM-dd HH:mm:ss"

TELEMETRY = T.StructType(
    [
        T.StructField("node", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        *[T.StructField(c, T.DoubleType()) for c in CHANNELS],
    ]
)

INCIDENT_TEXT = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("description", T.StringType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("date_start", T.StringType()),
        T.StructField("date_end", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)
