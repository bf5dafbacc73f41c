"""Sliding windows as rows of arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.functions.blocks import BLOCK, groups_of, over_blocks, with_halo
from fleetgauge.schema import SLIDE, WINDOW

_CELLS = 1 << 22  # values of windows made at once


def sliding_windows(
    df: DataFrame, channels: list[str], window: int = WINDOW, slide: int = SLIDE, block: int = BLOCK
) -> DataFrame:
    """Window `win` holds steps [win*slide, win*slide+window) of one machine, an array per channel.

    Windows that lack a step, or a value in any channel, are left out. The windows of many blocks are cut in one call.
    Output grows by window/slide; where only errors are wanted use the rolling forms instead.
    """
    kept = df.select("node", "ts", "i", *channels).where(F.col("i").isNotNull())
    arrays = [T.StructField(c, T.ArrayType(df.schema[c].dataType)) for c in channels]
    fields = [T.StructField("node", df.schema["node"].dataType), T.StructField("win", T.IntegerType())]
    schema = T.StructType([*fields, T.StructField("start_ts", df.schema["ts"].dataType), *arrays])

    def run(rows: pa.Table, begins: np.ndarray) -> pa.Table:
        steps = rows["i"].to_numpy().astype(np.int64)
        group = groups_of(rows, begins)
        # One axis for all blocks: a step of another block is always out of reach.
        low = np.minimum.reduceat(steps, begins)
        room = np.maximum.reduceat(steps, begins) - low + 1 + window
        place = steps + (np.cumsum(room) - room - low)[group]
        known = np.ones(len(rows), dtype=bool)
        for c in channels:
            known &= pc.is_valid(rows[c]).to_numpy()
        total = np.append(0, np.cumsum(known))
        last = np.flatnonzero((steps // block == rows["_blk"].to_numpy()) & ((steps - (window - 1)) % slide == 0))
        first, end = np.searchsorted(place, place[last] - window, "right"), np.searchsorted(place, place[last], "right")
        whole = (end - first == window) & (total[end] - total[first] == window)
        first, last = first[whole], last[whole]
        cells = pa.array((first[:, None] + np.arange(window)).ravel())
        edges = pa.array(np.arange(len(first) + 1, dtype=np.int32) * window)
        lists = [pa.ListArray.from_arrays(edges, rows[c].combine_chunks().take(cells)) for c in channels]
        win = ((steps[last] - (window - 1)) // slide).astype(np.int32)
        return pa.table([rows["node"].take(pa.array(last)), win, rows["ts"].take(pa.array(first)), *lists], names=schema.names)

    copies = max(window * len(channels) // slide, 1)  # a call holds what it makes
    return over_blocks(with_halo(kept, "i", window - 1, block), ["node"], "i", run, schema, window, max(_CELLS // copies, 1))


def window_at(windows: DataFrame, win: int) -> DataFrame:
    return windows.where(F.col("win") == win)


def last_window(windows: DataFrame, newest: int | None = None) -> DataFrame:
    return windows.where(F.col("win") == (windows.agg(F.max("win")).scalar() if newest is None else newest))


def last_n_windows(windows: DataFrame, n: int, newest: int | None = None) -> DataFrame:
    """Newest n windows; fails when there are fewer. A known newest number saves looking it up."""
    if newest is not None:
        if newest + 1 < n:
            raise ValueError(f"fewer than {n} windows in the history")
        return windows.where(F.col("win") > newest - n)
    newest = windows.agg(F.max("win")).scalar()
    enough = F.when(
        newest + 1 < n, F.raise_error(F.lit(f"fewer than {n} windows in the history")).cast("boolean")
    ).otherwise(F.lit(True))
    return windows.where((F.col("win") > newest - n) & enough)
