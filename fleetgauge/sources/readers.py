"""Reading telemetry and its companions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.functions.scalars import node_from_path, parse_ts
from fleetgauge.schema import INCIDENT_TEXT, TELEMETRY


def _time(df: DataFrame, column: str):
    """Timestamp column; nanosecond files (as pandas writes them) come in as whole numbers."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.LongType):
        c = F.timestamp_micros(F.floor(c / 1000))
    return c.cast("timestamp").alias("ts")


def read_raw(
    spark: SparkSession,
    path: str,
    channels: dict[str, str],
    host: str = "hostname",
    time: str = "date",
    schema: T.StructType | None = None,
) -> DataFrame:
    """Long readings: `node, ts` and the channels (output name -> source column)."""
    reader = spark.read.schema(schema) if schema else spark.read
    raw = reader.parquet(path)
    return raw.select(
        F.col(host).cast("string").alias("node"),
        _time(raw, time),
        *[F.col(src).alias(name) for name, src in channels.items()],
    )


def read_node_files(
    spark: SparkSession,
    folder: str,
    columns: list[str],
    time: str = "date",
    pattern: str = "*.parquet",
    chars: int | None = None,
    recursive: bool = False,
) -> DataFrame:
    """Folder with one parquet file per machine, named after it; other files are passed over.

    `recursive` reads folders named `node=<machine>` inside it, whatever the files are called.
    """
    path = F.col("_metadata.file_path")
    stem = F.regexp_extract(path, "/node=([^/]+)/", 1) if recursive else node_from_path("_metadata.file_path")
    reader = spark.read.option("pathGlobFilter", pattern)
    files = (reader.option("recursiveFileLookup", True) if recursive else reader).parquet(folder)
    return files.select(
        (stem if chars is None else F.substring(stem, 1, chars)).alias("node"),
        _time(files, time),
        *columns,
    )


def read_node_table(spark: SparkSession, folder: str) -> DataFrame:
    """What `write_node_files` wrote; a filter on `node` reads only that machine's folder."""
    return spark.read.schema(TELEMETRY).parquet(folder)


def load_scale(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("channel string, mn double, mx double").parquet(path)


def parse_incidents(text: DataFrame, tz: str | None = None) -> DataFrame:
    """Incident rows with times as text or already as timestamps."""
    def when(name: str):
        if isinstance(text.schema[name].dataType, T.StringType):
            return parse_ts(name, tz).alias(name)
        return F.col(name).cast("timestamp").alias(name)

    return text.select("id", "description", "severity", when("date_start"), when("date_end"), "tags")


def load_ground_truth(spark: SparkSession, path: str, tz: str | None = None) -> DataFrame:
    return parse_incidents(spark.read.schema(INCIDENT_TEXT).json(path), tz)


def import_error_table(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Rows of JSON tables `{"columns": [...], "data": [[...], ...]}`, one table per line or, with
    `multi_line`, one per file over any number of lines.

    Out come `(row, name, e)`. Large tables should be cut into many lines, each with its columns
    and a `first_row`: a line is the unit of work. Text that is no such table is an error.
    """
    reader = spark.read.schema("columns array<string>, data array<array<double>>, first_row long")
    doc = reader.option("mode", "FAILFAST").option("multiLine", multi_line).json(path)
    wrong = F.raise_error(F.lit("a table without columns or data")).cast("boolean")
    doc = doc.where(F.when(F.col("columns").isNull() | F.col("data").isNull(), wrong).otherwise(F.lit(True)))
    first = F.coalesce("first_row", F.lit(0))
    rows = doc.select("columns", first.alias("_f"), F.posexplode("data").alias("_r", "_cells"))
    cells = rows.select(
        (F.col("_f") + F.col("_r")).alias("row"),
        F.inline(F.arrays_zip(F.col("columns").alias("name"), F.col("_cells").alias("e"))),
    )
    return cells.toDF("row", "name", "e")


def load_metrics(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    runs = spark.read.parquet(path)
    return runs if run_id is None else runs.where(F.col("run_id") == run_id)
