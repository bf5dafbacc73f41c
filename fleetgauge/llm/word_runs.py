"""Periodic runs of words, found from an enhanced suffix array.

The words of a text are numbered; suffix array, its inverse (ISA) and the common prefixes of neighbours
(LCP) are made for many texts at once. An LCP interval of depth d holds the suffixes that share d words.
A square (a block of d words, twice) at i whose repetition ends right behind it has exactly d words in
common between the suffixes i and i+d, so the two lie in different children of one interval of depth d.
Each boundary between children is visited with its smaller side only: for each suffix i in it, ISA[i+d]
and ISA[i-d] tell whether the partner lies on the other side. Nested intervals at least double between
two visits of a suffix, so there are at most n log n of them. No tree is built: the sides of a boundary
are the next smaller LCP values to its left and right.

Every stretch with period d holds one such square, at its end. Rotating it to the left as far as the words
agree gives the whole stretch; stretches found with several periods merge into the one with the smallest.

Texts pass in groups of bounded size and never meet each other: a text's number is part of its words'
ranks, so copies of a text do not lengthen the common prefixes.

Nulls and texts without a word have no run. Repeated rows have equal results, a null id is not changed
before the search, an empty table gives an empty one, and other columns of the input do not pass.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 6
LEAST_POWER = 4
GROUP_WORDS = 1 << 18  # words searched at once; one longer text makes a group of its own


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts one after the other, and where each text's begin. Null texts have none.

    Words are runs of anything but space, tab, line feed, vertical tab, form feed and return.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # white ends leave empty ones
    return words.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]]


def prefix_ranks(words: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... words, until all differ; equal rank, equal words.

    A suffix that ends early stands before longer ones. Only suffixes not yet alone are ranked again.
    """
    n = len(words)
    _, rank = np.unique(text * (int(words.max(initial=0)) + 1) + words, return_inverse=True)
    first = np.concatenate([[0], np.cumsum(np.bincount(rank))])
    levels = [first[rank]]  # rank: place of the first suffix that is equal so far
    size = 1
    while True:
        rank = levels[-1]
        count = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(count[rank] > 1)
        if not len(open_):
            return levels
        ahead = open_ + size
        second = np.full(len(open_), -1, np.int64)
        inside = ahead < n
        inside[inside] = text[ahead[inside]] == text[open_[inside]]
        second[inside] = rank[ahead[inside]]
        order = np.lexsort((second, rank[open_]))
        suffix, r, s = open_[order], rank[open_][order], second[order]
        new_rank = np.r_[True, r[1:] != r[:-1]]
        new = new_rank | np.r_[True, s[1:] != s[:-1]]
        at = np.arange(len(order))
        group = np.maximum.accumulate(np.where(new_rank, at, 0))
        begin = np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[suffix] = r + begin - group
        levels.append(rank)
        size *= 2


def common(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words agree from i and j on; with `back`, before them."""
    n = len(levels[0])
    out = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        a, b = (i - out - step, j - out - step) if back else (i + out, j + out)
        live = np.flatnonzero((a >= 0) & (b >= 0) & (a < n) & (b < n))
        live = live[levels[k][a[live]] == levels[k][b[live]]]
        out[live] += step
    return out


def nearest_smaller(values: np.ndarray, at: np.ndarray, or_equal: bool, left: bool) -> np.ndarray:
    """Nearest place to the left or right of each of `at` with a smaller (or equal) value; both ends hold 0 or less.

    Jumps over the minima of 1, 2, 4, ... places, first in growing, then in falling steps.
    """
    sign = -1 if left else 1
    n = len(values)
    minima = [values]  # minima[k][p]: least of the 2^k values from p on, in the direction
    while (1 << len(minima)) <= n:
        prev, half = minima[-1], 1 << (len(minima) - 1)
        best = prev.copy()
        if left:
            best[half:] = np.minimum(prev[half:], prev[:-half])
        else:
            best[:-half] = np.minimum(prev[:-half], prev[half:])
        minima.append(best)
    mine = values[at]
    place = at + sign
    for k in range(len(minima) - 1, -1, -1):
        step = 1 << k
        reach = place + sign * (step - 1)
        inside = (reach >= 0) & (reach < n)
        least = np.where(inside, minima[k][np.where(inside, place, 0)], -1)
        place = np.where((least > mine) if or_equal else (least >= mine), place + sign * step, place)
    return place


def _spread(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places begin .. begin + size - 1 of each, and whose they are."""
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + begin[owner], owner


def ending_squares(levels: list[np.ndarray], text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, d) of the squares whose period ends right behind them."""
    n = len(text)
    isa = levels[-1]
    suffixes = np.empty(n, np.int64)
    suffixes[isa] = np.arange(n)
    lcp = np.zeros(n + 1, np.int64)
    near = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]]) + 1  # others share no word
    lcp[near] = common(levels, suffixes[near - 1], suffixes[near])
    edges = near
    depth = lcp[edges]
    before = nearest_smaller(lcp, edges, or_equal=False, left=True)  # left side: before .. edge - 1
    after = nearest_smaller(lcp, edges, or_equal=True, left=False)  # right side: edge .. after - 1
    left_small = edges - before <= after - edges
    begin = np.where(left_small, before, edges)
    size = np.where(left_small, edges - before, after - edges)
    low = np.where(left_small, edges, before)  # the other side
    high = np.where(left_small, after, edges)
    starts, periods = [], []
    for lo, hi in _slices(size):
        place, owner = _spread(begin[lo:hi], size[lo:hi])
        owner = owner + lo
        i, d = suffixes[place], depth[owner]
        for j in (i + d, i - d):
            inside = (j >= 0) & (j < n)
            at = isa[np.where(inside, j, 0)]
            found = inside & (at >= low[owner]) & (at < high[owner])
            starts.append(np.minimum(i, j)[found])
            periods.append(d[found])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(periods)


def _slices(size: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of about `most` units, so that nested intervals are not all unfolded at once."""
    total = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def runs(words: np.ndarray, text: np.ndarray, least: int = LEAST_WORDS, power: int = LEAST_POWER) -> np.ndarray:
    """(start, end, period) of all runs, ascending; `words` are numbers, `text` says which text each is of, ascending."""
    if not len(words):
        return np.zeros((0, 3), np.int64)
    levels = prefix_ranks(words.astype(np.int64), text.astype(np.int64))
    start, period = ending_squares(levels, text)
    end = start + 2 * period
    start = start - common(levels, start, start + period, back=True)
    long = end - start >= np.maximum(least, power * period)
    found = np.stack([start[long], end[long], period[long]], 1)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[new]  # one stretch found with several periods: the smallest
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def strongest(found: np.ndarray) -> tuple[int, int, int]:
    """(start, length, period) of the run with the greatest length / period; `found` ascends by start and period."""
    best = None
    for start, end, period in found.tolist():
        if best is None or (end - start) * best[2] > best[1] * period:
            best = (start, end - start, period)
    return best


def planted_order(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which original word stands at each place of the texts that are made periodic, or None."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at >= a, a + (at - a) % p, at)


class Group:
    """Some texts as word numbers, with the changes of `planted_order` if ids are given."""

    def __init__(self, words: pa.Array, offsets: np.ndarray, ids: list | None):
        self.sizes = np.diff(offsets)
        self.offsets = offsets - offsets[0]
        source = np.arange(self.offsets[-1])
        for k, doc_id in enumerate(ids or []):
            order = planted_order(int(self.sizes[k]), doc_id)
            if order is not None:
                source[self.offsets[k] : self.offsets[k + 1]] = order + self.offsets[k]
        own = words.slice(offsets[0], offsets[-1] - offsets[0])
        self.words = own.take(pa.array(source)) if ids else own
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.codes = self.words.dictionary_encode().indices.to_numpy()

    def runs(self) -> list[np.ndarray]:
        """Runs of each text, in its own word numbers."""
        found = runs(self.codes, self.text)
        self.found = found
        at = np.searchsorted(found[:, 0], self.offsets)
        return [found[at[k] : at[k + 1]] - [self.offsets[k], self.offsets[k], 0] for k in range(len(self.sizes))]

    def collapsed(self) -> list[str]:
        """Texts without the words that repeat the first period of a run, joined by one space."""
        step = np.zeros(len(self.codes) + 1, np.int64)
        np.add.at(step, self.found[:, 0] + self.found[:, 2], 1)
        np.add.at(step, self.found[:, 1], -1)
        kept = np.cumsum(step)[:-1] == 0
        offsets = np.concatenate([[0], np.cumsum(kept)])[self.offsets]
        lists = pa.LargeListArray.from_arrays(pa.array(offsets), self.words.filter(pa.array(kept)))
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).to_pylist()


def grouped(texts: pa.Array, ids: list | None = None) -> Iterator[tuple[int, Group]]:
    """(number of the first text, group) over all texts."""
    words, offsets = split_words(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + GROUP_WORDS, side="right")) - 1)
        last = min(last, len(texts))
        yield first, Group(words, offsets[first : last + 1], ids[first:last] if ids is not None else None)
        first = last


def find_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, runs, collapsed`: runs as (start, length, period) by start and period, and the text without repeats."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, group in grouped(batch.column(1)):
                found = [[{"start": s, "length": e - s, "period": p} for s, e, p in r.tolist()] for r in group.runs()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(found)), pa.array(found, _RUNS), pa.array(group.collapsed(), pa.string())],
                    names=["doc_id", "runs", "collapsed"],
                )

    kind = dict(df.dtypes)[doc_id]
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(work, f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def digest(df: DataFrame) -> DataFrame:
    """Counts, strongest run and hashes of the planted texts of `documents`, a row per row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, group in grouped(batch.column(1), ids):
                rows = []
                for doc_id, found, text in zip(ids[first:], group.runs(), group.collapsed(), strict=False):
                    start, length, period = strongest(found) or (None, None, None)
                    listed = "".join(f"{s},{e - s},{p}\n" for s, e, p in found.tolist())
                    rows.append({
                        "doc_id": doc_id, "n_runs": len(found), "start": start, "length": length, "period": period,
                        "exponent_milli": None if start is None else 1000 * length // period,
                        "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(),
                        "collapsed_sha256": hashlib.sha256(text.encode()).hexdigest(),
                    })
                yield pa.RecordBatch.from_pylist(rows, schema)

    kind = dict(df.dtypes)["doc_id"]
    numbers = ("n_runs", "start", "length", "period", "exponent_milli")
    texts = ("runs_sha256", "collapsed_sha256")
    rows = df.select("doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in numbers), *((t, pa.string()) for t in texts)])
    return rows.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        work, "doc_id long, " + ", ".join([*(f"{n} long" for n in numbers), *(f"{t} string" for t in texts)])
    ).select(F.col("doc_id").cast(kind), *numbers, *texts)
