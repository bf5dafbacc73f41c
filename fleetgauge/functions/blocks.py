"""Trailing sums over long series, in blocks of steps.

A window function partitioned by machine alone would put a machine's whole history into one
task, and a fleet series has no partition key at all. Here the step axis is cut into blocks of
fixed length; each row is also copied into the later blocks whose first rows still look back at
it. The unit of work is (keys, block), so its size has a fixed bound however long a series is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 4096


def with_halo(df: DataFrame, pos: str, before: int, block: int = BLOCK) -> DataFrame:
    """Add `_blk`; a row appears in its own block and in those that need it as a lead-in."""
    first = F.floor(F.col(pos) / block)
    if before == 0:
        return df.withColumn("_blk", first)
    last = F.floor((F.col(pos) + before) / block)
    return df.withColumn("_blk", F.explode(F.sequence(first, last)))


def all_known(columns: list[str]) -> Column:
    """Whether a row has a value in every column."""
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    return known


def whole_starts(steps: np.ndarray, known: np.ndarray, own: np.ndarray, window: int, slide: int, group: np.ndarray | None = None) -> np.ndarray:
    """Places where a window begins whose last step is one of `own`, with every step there and known.

    With rows of several blocks, `group` tells them apart; windows stay within one."""
    starts = np.flatnonzero(own) - (window - 1)
    starts = starts[starts >= 0]
    total = np.concatenate([[0], np.cumsum(known)])
    there = (steps[starts + window - 1] - steps[starts] == window - 1) & (total[starts + window] - total[starts] == window)
    if group is not None:
        there &= group[starts + window - 1] == group[starts]
    return starts[there & (steps[starts] % slide == 0)]


def sliding_sums(x: np.ndarray, width: int) -> np.ndarray:
    """Sums of the `width` values up to and with each one on the last axis, zeros ahead of the first; two additions a value.

    The axis is cut into stretches of that width. A frame is the end of one stretch and the beginning of the next, so it
    is a sum from the back and one from the front. Only values of the frame enter: a NaN is gone after `width` steps.
    """
    lead, size = width - 1, x.shape[-1]
    room = -(-(lead + size) // width) * width
    cut = np.zeros((*x.shape[:-1], room))
    cut[..., lead : lead + size] = x
    rows, cut = cut.shape, cut.reshape(*x.shape[:-1], -1, width)
    with np.errstate(invalid="ignore", over="ignore"):
        front = np.cumsum(cut, axis=-1).reshape(rows)[..., lead : lead + size]
        back = np.cumsum(cut[..., ::-1], axis=-1)[..., ::-1].reshape(rows)[..., :size]
        apart = np.arange(size) % width != 0  # else the frame is one stretch
        return front + np.where(apart, back, 0.0)


class Axis:
    """Rows of several blocks on one axis of steps: each block begins at a multiple of `even`, at least `back` empty steps behind
    the one ahead of it. With the widths of sums as `even`, sums are added in the same order wherever a block lies."""

    def __init__(self, rows: pa.Table, begins: np.ndarray, pos: str, back: int, even: int):
        self.at, self.begins = rows[pos].to_numpy().astype(np.int64), begins
        self.counts = np.diff(np.append(begins, len(self.at)))
        low = self.at[begins]
        room = -(-(self.at[begins + self.counts - 1] - low + 1 + back) // even) * even
        self.size = int(room.sum())
        self.place = self.at + np.repeat(np.cumsum(room) - room - low, self.counts)

    def along(self, values: np.ndarray) -> np.ndarray:
        axis = np.zeros(self.size)
        axis[self.place] = values
        return axis

    def least(self, x: np.ndarray, known: np.ndarray) -> np.ndarray:
        """For each row the smallest finite value of its block."""
        low = np.minimum.reduceat(np.where(known & np.isfinite(x), x, np.inf), self.begins)
        return np.repeat(np.where(np.isfinite(low), low, 0.0), self.counts)

    def row_at(self, places: np.ndarray) -> np.ndarray:
        """Rows that lie at these places, -1 where none does."""
        axis = np.full(self.size, -1)
        axis[self.place] = np.arange(len(self.at))
        return np.where(places >= 0, axis[np.maximum(places, 0)], -1)


_CELLS = 1 << 20  # steps of an axis worked on at once


def _begins(rows: pa.Table, names: list[str]) -> np.ndarray:
    """Rows at which a key differs from the row ahead of it, without the first row."""
    new = np.zeros(max(len(rows) - 1, 0), dtype=bool)
    for c in names:
        code = rows[c].combine_chunks().dictionary_encode("encode")
        code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy()
        new |= code[1:] != code[:-1]
    return np.flatnonzero(new) + 1


def over_blocks(
    parts: DataFrame, keys: list[str], pos: str, run: Callable[[pa.Table, np.ndarray], pa.Table], schema: T.StructType | str, room: int,
    most: int = _CELLS,
) -> DataFrame:
    """`run` on many blocks (keys, _blk) at once: their rows in order of (keys, _blk, pos) and the row at which each begins.

    A call for each block would cost more than its sums where machines have few steps. Rows without a position lead their block. `room` is what a
    block takes on an axis besides its steps: it bounds how many blocks one call gets, with about `most` steps in all.
    """
    names = [*keys, "_blk"]

    def portions(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        begins = np.append(0, _begins(rows, names))
        at = pc.fill_null(rows[pos].cast(pa.int64()), pc.min(rows[pos]).cast(pa.int64())).to_numpy() if rows[pos].null_count < len(rows) else np.zeros(len(rows), np.int64)
        ends = np.append(begins[1:], len(rows))
        cells = np.maximum.reduceat(at, begins) - np.minimum.reduceat(at, begins) + 1 + room
        portion = np.cumsum(cells) // most
        for k in np.unique(portion):
            some = np.flatnonzero(portion == k)
            low, high = begins[some[0]], ends[some[-1]]
            yield from run(rows.slice(low, high - low), begins[some] - low).combine_chunks().to_batches()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the last block may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not len(rows):
                continue
            if held:
                cuts = _begins(pa.concat_tables([held[-1].slice(len(held[-1]) - 1), rows]), names) - 1
            else:
                cuts = _begins(rows, names)
            if len(cuts):
                if held or cuts[-1]:
                    yield from portions(pa.concat_tables([*held, rows.slice(0, cuts[-1])]))
                held, rows = [], rows.slice(cuts[-1])
            held.append(rows)
        if held:
            yield from portions(pa.concat_tables(held))

    return parts.repartition(*names).sortWithinPartitions(*names, pos).mapInArrow(each, schema)


def groups_of(rows: pa.Table, begins: np.ndarray) -> np.ndarray:
    """For each row the number of its block."""
    return np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(rows))))


def trailing_sums(
    df: DataFrame,
    keys: list[str],
    pos: str,
    columns: list[str],
    widths: list[int],
    first: dict[str, int] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """For each row sums and counts over the steps (pos - w, pos]: `<col>_s<w>`, `<col>_n<w>`, `_rows<w>`.

    Constant work a row, whatever the widths. A step has one row or none, and frames go by step, so missing
    steps make a frame smaller whatever the block. Sums are taken of the distances from the smallest value of
    the block, so a constant series has equal sums. `first` maps a column to a width: `<col>_first` is its
    value at the first step of that frame, null where that step is missing.
    """
    widths = list(dict.fromkeys(widths))
    first = first or {}
    back, even = max([*widths, *first.values()]) - 1, math.lcm(*widths)
    kept = df.columns
    made = [(f"_rows{w}", T.LongType()) for w in widths]
    made += [x for w in widths for c in columns for x in ((f"{c}_s{w}", T.DoubleType()), (f"{c}_n{w}", T.LongType()))]
    made += [(f"{c}_first", df.schema[c].dataType) for c in first]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in made)])

    def run(rows: pa.Table, begins: np.ndarray) -> pa.Table:
        axis = Axis(rows, begins, pos, back, even)
        own = axis.at // block == rows["_blk"].to_numpy()
        own_rows = rows.filter(pa.array(own)).select(kept)
        mine = axis.place[own]
        out = {c: own_rows[c] for c in kept}
        there = axis.along(np.ones(len(axis.at)))
        seen = {w: sliding_sums(there, w)[mine].astype(np.int64) for w in widths}
        for w in widths:
            out[f"_rows{w}"] = seen[w]
        for c in columns:
            known = pc.is_valid(rows[c]).to_numpy()
            x = pc.fill_null(rows[c].cast(pa.float64()), 0.0).to_numpy()
            least = axis.least(x, known)
            apart, count = axis.along(np.where(known, x - least, 0.0)), None if known.all() else axis.along(known)
            for w in widths:
                n = seen[w] if count is None else sliding_sums(count, w)[mine].astype(np.int64)
                out[f"{c}_s{w}"] = sliding_sums(apart, w)[mine] + n * least[own]
                out[f"{c}_n{w}"] = n
        for c, w in first.items():
            found = axis.row_at(mine - (w - 1))
            out[f"{c}_first"] = rows[c].take(pa.array(found, mask=found < 0))
        return pa.table([out[f.name] for f in schema.fields], names=schema.names)

    return over_blocks(with_halo(df, pos, back, block), keys, pos, run, schema, back + even)
