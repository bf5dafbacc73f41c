"""Reconstruction of windows: a daily profile, a linear bottleneck, or any caller's function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.functions.blocks import BLOCK, all_known, groups_of, over_blocks, whole_starts, with_halo
from fleetgauge.functions.scalars import flatten_window
from fleetgauge.schema import SLIDE, WINDOW

Reconstructor = Callable[[np.ndarray], np.ndarray]  # (windows, channels, steps) -> same shape


def fit_profile(df: DataFrame, channels: list[str]) -> DataFrame:
    """Mean per machine and hour of day, as `<channel>_hat`."""
    return df.groupBy("node", F.hour("ts").alias("hour")).agg(
        *[F.avg(c).alias(f"{c}_hat") for c in channels]
    )


def apply_profile(df: DataFrame, profile: DataFrame) -> DataFrame:
    return df.withColumn("hour", F.hour("ts")).join(profile, ["node", "hour"]).drop("hour")


def _rebuilt(fn: Reconstructor, block: np.ndarray) -> np.ndarray:
    out = np.asarray(fn(block))
    if out.shape != block.shape:
        out = out.reshape(block.shape)  # raises when the sizes differ
    return out


def score_windows(windows: DataFrame, fn: Reconstructor, channels: list[str]) -> DataFrame:
    """Add `<channel>_hat` arrays to written-out windows, Arrow batch by Arrow batch."""
    keys = ["node", "win", "start_ts"]
    array = T.ArrayType(T.DoubleType())
    schema = T.StructType([*(windows.schema[k] for k in keys), *(T.StructField(n, array) for c in channels for n in (c, f"{c}_hat"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            n = rows.num_rows
            if not n:
                continue
            block = np.stack([rows[c].flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in channels], axis=1)
            hat = _rebuilt(fn, block)
            edges = pa.array(np.arange(n + 1, dtype=np.int32) * block.shape[2])
            out = [rows[k] for k in keys]
            for k, c in enumerate(channels):
                values = rows[c].flatten().cast(pa.float64()), pa.array(np.ascontiguousarray(hat[:, k, :], dtype=float).ravel())
                out += [pa.ListArray.from_arrays(edges, x) for x in values]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return windows.select(*keys, *channels).mapInArrow(run, schema)


def score_series(
    df: DataFrame,
    fn: Reconstructor,
    channels: list[str],
    window: int = WINDOW,
    slide: int = SLIDE,
    block: int = BLOCK,
    batch: int = 4096,
) -> DataFrame:
    """Errors of a window function without writing windows out.

    A task takes bounded blocks of steps, many at once, cuts windows as views, scores them in
    batches and returns only the L1 and L2 errors: `node, win, ts, l1_<c>, l2_<c>, l1, l2`. Windows
    that lack a step, or a value in any channel, are left out, as in `sliding_windows`.
    """
    names = [f"_x{k}" for k in range(len(channels))]
    made = [*[f"{n}_{c}" for n in ("l1", "l2") for c in channels], "l1", "l2"]
    fields = [T.StructField("node", df.schema["node"].dataType), T.StructField("win", T.IntegerType()), T.StructField("ts", df.schema["ts"].dataType)]
    schema = T.StructType([*fields, *(T.StructField(n, T.DoubleType()) for n in made)])

    def score(rows: pa.Table, begins: np.ndarray) -> pa.Table:
        steps = rows["i"].to_numpy().astype(np.int64)
        own = steps // block == rows["_blk"].to_numpy()
        starts = whole_starts(steps, rows["_known"].to_numpy(), own, window, slide, groups_of(rows, begins))
        l1 = np.empty((len(starts), len(channels)))
        l2 = np.empty_like(l1)
        if len(starts):
            values = np.stack([pc.fill_null(rows[x], np.nan).to_numpy() for x in names], axis=1)
            views = np.lib.stride_tricks.sliding_window_view(values, window, axis=0)
            for at in range(0, len(starts), batch):
                part = views[starts[at : at + batch]]
                gap = part - _rebuilt(fn, part)
                l1[at : at + batch] = np.abs(gap).mean(axis=2)
                l2[at : at + batch] = np.square(gap).mean(axis=2)
        taken = pa.array(starts)
        out = [rows["node"].take(taken), (steps[starts] // slide).astype(np.int32), rows["ts"].take(taken)]
        out += [e[:, k] for e in (l1, l2) for k in range(len(channels))]
        return pa.table([*out, l1.mean(axis=1), l2.mean(axis=1)], names=schema.names)

    values = [F.col(c).cast("double").alias(x) for c, x in zip(channels, names, strict=True)]
    kept = df.where(F.col("i").isNotNull()).select("node", "ts", "i", *values, all_known(channels).alias("_known"))
    return over_blocks(with_halo(kept, "i", window - 1, block), ["node"], "i", score, schema, window)


def fit_linear(windows: DataFrame, channels: list[str], latent: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading axes of flattened windows: the optimum of a linear bottleneck.

    The model has (channels * window) * latent numbers whatever the data size.
    """
    flat = windows.select(array_to_vector(flatten_window(channels)).alias("v"))
    axes = PCA(k=latent, inputCol="v", outputCol="z").fit(flat).pc.toArray()
    mean = flat.select(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray()
    return mean, axes


def cross_sums(x: np.ndarray, starts: np.ndarray, window: int, slide: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and sum of outer products of the flattened windows of x (steps, channels) that begin at rows `starts`.

    Two places of a window that lie `lag` steps apart meet the same products in every window, only shifted. So the products
    of each lag are made once and added up along the steps; a sum over windows is a difference of two of these.
    """
    width = x.shape[1]
    total, gram = np.zeros((width, window)), np.zeros((width, window, width, window))
    for run in np.split(starts, np.flatnonzero(np.diff(starts) != slide) + 1):
        if not len(run):
            continue
        y = np.nan_to_num(x[run[0] : run[-1] + window])  # what is not a number here lies between windows

        def over_windows(p: np.ndarray, places: int, n: int = len(run)) -> np.ndarray:
            room = -(-len(p) // slide) * slide + slide
            laid = np.zeros((room, p.shape[1]))
            laid[slide : slide + len(p)] = p
            sums = np.cumsum(laid.reshape(-1, slide, p.shape[1]), axis=0)
            a = np.arange(places)
            return sums[a // slide + n, a % slide] - sums[a // slide, a % slide]

        total += over_windows(y, window).T
        for lag in range(window):
            p = (y[: len(y) - lag, :, None] * y[lag:, None, :]).reshape(len(y) - lag, -1)
            met = over_windows(p, window - lag).reshape(-1, width, width)
            a = np.arange(window - lag)
            gram[:, a, :, a + lag] += met
            if lag:
                gram[:, a + lag, :, a] += met.transpose(0, 2, 1)
    return total.reshape(-1), gram.reshape(width * window, width * window)


_OVERLAP = 32  # windows that share a step up to which their products are cheaper than products of steps a lag apart


def fit_linear_series(
    df: DataFrame, channels: list[str], window: int = WINDOW, slide: int = SLIDE, latent: int = 32, block: int = BLOCK
) -> tuple[np.ndarray, np.ndarray]:
    """`fit_linear` of the windows of a table of steps, none of which is written out.

    A task goes through its blocks, many at once, and returns one table of sums, whose size depends on the model alone; these
    add up in two rounds. Windows that lack a step, or a finite value in any channel, are left out.
    """
    size = len(channels) * window
    finite = [F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c) for c in (F.col(c).cast("double") for c in channels)]
    at = df.agg(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in finite]).first()  # sums around the means lose fewer digits
    centre = np.array(at, dtype=float)
    plain = df.select("node", F.col("i").cast("long").alias("i"), *[c.alias(f"_x{k}") for k, c in enumerate(finite)])
    names = [f"_x{k}" for k in range(len(channels))]
    parts = with_halo(plain, "i", window - 1, block).repartition("node", "_blk").sortWithinPartitions("node", "_blk", "i")

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, gram = 0, np.zeros(size), np.zeros((size, size))
        held = None

        def add(part: pd.DataFrame, begins: np.ndarray) -> None:
            nonlocal n, total, gram
            steps, x = part["i"].to_numpy(), part[names].to_numpy(dtype=float) - centre
            group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(part))))
            starts = whole_starts(steps, ~np.isnan(x).any(axis=1), steps // block == part["_blk"].to_numpy(), window, slide, group)
            if not len(starts):
                return
            n += len(starts)
            if window > _OVERLAP * slide:
                for some in np.split(starts, np.flatnonzero(np.diff(group[starts])) + 1):
                    s, g = cross_sums(x, some, window, slide)
                    total, gram = total + s, gram + g
                return
            views = np.lib.stride_tricks.sliding_window_view(x, window, axis=0)
            for at in range(0, len(starts), 1024):
                flat = views[starts[at : at + 1024]].reshape(-1, size)
                total, gram = total + flat.sum(axis=0), gram + flat.T @ flat

        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            node, blk = pdf["node"].to_numpy(dtype=object), pdf["_blk"].to_numpy()
            begins = np.append(0, np.flatnonzero((node[1:] != node[:-1]) | (blk[1:] != blk[:-1])) + 1)
            if begins[-1]:
                add(pdf.iloc[: begins[-1]], begins[:-1])
            held = pdf.iloc[begins[-1] :]  # the last block may go on in the next batch
        if held is not None:
            add(held, np.zeros(1, np.int64))
        if n:
            yield pd.DataFrame({"n": [n], "sums": [np.concatenate([total, gram.reshape(-1)])]})

    each = parts.mapInPandas(add_up, "n long, sums array<double>").select("n", array_to_vector("sums").alias("sums"))
    some = each.groupBy((F.spark_partition_id() % 16).alias("k")).agg(F.sum("n").alias("n"), Summarizer.sum(F.col("sums")).alias("sums"))
    row = some.groupBy(F.lit("all")).agg(F.sum("n").alias("n"), Summarizer.sum(F.col("sums")).alias("sums")).first()
    if row is None:
        raise ValueError("no whole window to fit")
    sums, n = row["sums"].toArray(), row["n"]
    mean, gram = sums[:size] / n, sums[size:].reshape(size, size)
    spread = gram / n - np.outer(mean, mean)
    axes = np.linalg.eigh((spread + spread.T) / 2)[1][:, ::-1][:, :latent]
    return mean + np.repeat(centre, window), axes


def linear_reconstructor(model: tuple[np.ndarray, np.ndarray]) -> Reconstructor:
    mean, axes = model

    def rebuild(block: np.ndarray) -> np.ndarray:
        flat = block.reshape(len(block), -1) - mean
        return (flat @ axes @ axes.T + mean).reshape(block.shape)

    return rebuild
