"""Column expressions, every one of them inside generated code, and the status of the fleet as one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.schema import TS_TEXT


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """Division that yields NULL for a zero divisor."""
    return F.try_divide(_col(top), _col(bottom))


def normalize(x: Column | str, low: Column, high: Column) -> Column:
    return ratio(_col(x) - low, high - low)


def denormalize(x: Column | str, low: Column, high: Column) -> Column:
    return _col(x) * (high - low) + low


def _at(x: Column | str | float, digits: int | None) -> Column:
    column = F.lit(x) if isinstance(x, (int, float)) else _col(x)
    return column if digits is None else F.round(column, digits)


def threshold_gt(x: Column | str, t: Column | str | float, digits: int | None = None) -> Column:
    """1 where x > t, else 0. `digits` sets the precision at which the two are told apart."""
    return (_at(x, digits) > _at(t, digits)).cast("int")


def threshold_ge(x: Column | str, t: Column | str | float, digits: int | None = None) -> Column:
    return (_at(x, digits) >= _at(t, digits)).cast("int")


def abs_error(x: Column | str, y: Column | str) -> Column:
    return F.abs(_col(x) - _col(y))


def sq_error(x: Column | str, y: Column | str) -> Column:
    gap = _col(x) - _col(y)
    return gap * gap


def contribution(d: Column | str, total: Column) -> Column:
    return ratio(d, total)


def node_from_path(path: Column | str) -> Column:
    """File stem of a parquet path."""
    return F.regexp_extract(_col(path), r"([^/]+)\.parquet$", 1)


def node_prefix(path: Column | str, chars: int = 5) -> Column:
    return F.substring(F.regexp_extract(_col(path), r"([^/]+)$", 1), 1, chars)


def parse_periods(text: Column | str) -> Column:
    """`"a,b&c,d"` -> array of (from, to) days; blank text gives an empty array."""
    parts = F.filter(F.split(_col(text), "&"), lambda p: F.trim(p) != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            F.to_date(F.trim(F.split(p, ",")[0])).alias("from"),
            F.to_date(F.trim(F.split(p, ",")[1])).alias("to"),
        ),
    )


def parse_hosts(text: Column | str) -> Column:
    """`"a,b,"` -> array of names without blanks."""
    return F.filter(
        F.transform(F.split(_col(text), ","), lambda h: F.trim(h)), lambda h: h != ""
    )


def parse_ts(text: Column | str, tz: str | None = None) -> Column:
    ts = F.to_timestamp(_col(text), TS_TEXT)
    return ts if tz is None else F.to_utc_timestamp(ts, tz)


def format_ts(ts: Column | str) -> Column:
    return F.date_format(_col(ts), TS_TEXT)


def local_ts(ts: Column | str, tz: str) -> Column:
    return F.from_utc_timestamp(_col(ts), tz)


def shift_minutes(ts: Column | str, minutes: Column | int) -> Column:
    amount = F.lit(minutes) if isinstance(minutes, int) else minutes
    return F.timestamp_add("MINUTE", amount, _col(ts))


def flatten_window(columns: list[str]) -> Column:
    """One flat array out of one array per channel, channel after channel."""
    return F.flatten(F.array(*[F.col(c) for c in columns]))


def status_json(error: Column | str, flag: Column | str) -> Column:
    """Status of one machine as JSON text."""
    return F.to_json(F.struct(_col(error).alias("r_err"), _col(flag).alias("is_anomaly")))


def fleet_json(statuses: DataFrame, most: int = 100_000) -> DataFrame:
    """One row `status`: JSON text of the whole fleet, machine -> status, in order of machine.

    `statuses` has a row per machine: `node, r_err, is_anomaly`. The document is one value, so more than `most` machines
    are an error; keep a row per machine (`status_json`) for fleets beyond it.
    """
    entry = F.struct("node", F.struct("r_err", "is_anomaly").alias("status"))
    held = statuses.where(F.col("node").isNotNull()).limit(most + 1)
    count = F.when(F.count("*") > most, F.raise_error(F.lit(f"more than {most} machines")).cast("long")).otherwise(F.count("*"))
    ordered = F.array_sort(F.collect_list(entry))
    text = F.to_json(F.map_from_entries(ordered), {"ignoreNullFields": "false"})
    return held.agg(text.alias("status"), count.alias("_n")).where(F.col("_n") >= 0).select("status")
