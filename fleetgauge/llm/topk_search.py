"""Exact top-k search: exhaustive accumulation term at a time.

Vectors become whole numbers, floor(scale * x). Rows are packed into blocks of bounded size; a block of
candidates is turned into postings (component -> places and weights). Each block of queries meets each
block of candidates once. For every term of the queries the weighted postings of the term are added
into dense score arrays, a row of scores per query; components that are 0 have no posting, so
sparse vectors cost what they hold. Each meeting keeps the k best of every query, exactly, ties to the
smaller id; the kept ones are merged per query.

Vectors that are null or hold a null, NaN or infinite component take no part. Vectors of different length
meet on the components both have. A query meets every row but those with its own id. Rows that repeat an id are
rows of their own, as queries and as candidates; a null id comes last among ties. Scores are 64-bit whole
numbers; beyond that they wrap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetgauge.session import written

CANDIDATES = 8192  # rows in a block
QUERIES = 256
SCALE = 256.0


def _usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return df.select(F.col(vec_id).cast("long").alias("id"), x.alias("v")).where(F.col("v").isNotNull() & ~bad)


def pack_blocks(rows: DataFrame, size: int, scale: float) -> DataFrame:
    """`block, ids, has_id, lengths, values`: rows packed in blocks of about `size`, written."""
    n = rows.count()
    blocks = max(1, -(-n // size))
    dealt = rows.withColumn("block", (F.monotonically_increasing_id() % blocks).cast("int"))
    laid = dealt.repartition("block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        vectors: list[np.ndarray] = []
        at = None

        def flush() -> pa.RecordBatch:
            values = np.concatenate(vectors) if vectors else np.zeros(0)
            whole = np.clip(np.floor(values * scale), -(2.0**63), 2.0**63 - 1024).astype(np.int64)
            columns = [
                pa.array([at], pa.int32()),
                pa.array([np.array([i or 0 for i in ids], np.int64).tobytes()], pa.binary()),
                pa.array([np.array([i is not None for i in ids], np.uint8).tobytes()], pa.binary()),
                pa.array([np.array([len(v) for v in vectors], np.int32).tobytes()], pa.binary()),
                pa.array([whole.tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "has_id", "lengths", "values"])

        for batch in batches:
            lists = batch.column(1)
            for k, (i, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if b != at:
                    if ids:
                        yield flush()
                    ids, vectors, at = [], [], b
                ids.append(i)
                vectors.append(lists[k].values.to_numpy(zero_copy_only=False))
        if ids:
            yield flush()

    return written(laid.mapInArrow(run, "block int, ids binary, has_id binary, lengths binary, values binary"), "blocks")


class Block:
    def __init__(self, ids: bytes, has_id: bytes, lengths: bytes, values: bytes):
        self.ids, self.has_id = np.frombuffer(ids, np.int64), np.frombuffer(has_id, np.uint8).astype(bool)
        sizes = np.frombuffer(lengths, np.int32).astype(np.int64)
        flat = np.frombuffer(values, np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        term = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        held = flat != 0
        order = np.argsort(term[held], kind="stable")
        self.places, self.weights, terms = row[held][order], flat[held][order], term[held][order]
        self.terms, starts = np.unique(terms, return_index=True)
        self.starts = np.append(starts, len(terms))

    def posting(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.places[self.starts[k] : self.starts[k + 1]], self.weights[self.starts[k] : self.starts[k + 1]]


_TILE = 128  # places scored at once, so that the scores stay in the processor's cache
_FULL = 4  # a term that is in at least one of so many rows, on both sides, is laid out with 0 for the others


def scores(queries: Block, candidates: Block) -> np.ndarray:
    """Inner products, a row per query: each shared term scatters its weighted postings."""
    n, asked = len(candidates.ids), len(queries.ids)
    out = np.zeros((n, asked), np.int64)
    shared, at_q, at_c = np.intersect1d(queries.terms, candidates.terms, return_indices=True)
    terms, full = [], []
    for q, c in zip(at_q, at_c, strict=True):
        (q_places, q_weights), (places, weights) = queries.posting(q), candidates.posting(c)
        if _FULL * len(q_places) < asked or _FULL * len(places) < n:
            terms.append((q_places, q_weights, places, weights))
            continue
        of_q, of_c = np.zeros((1, asked), np.int64), np.zeros((n, 1), np.int64)
        of_q[0, q_places], of_c[places, 0] = q_weights, weights
        full.append((of_q, of_c))
    add = np.empty((_TILE, asked), np.int64)
    for lo in range(0, n, _TILE):
        hi = min(lo + _TILE, n)
        tile = out[lo:hi]
        for of_q, of_c in full:
            tile += np.multiply(of_c[lo:hi], of_q, out=add[: hi - lo])
        for q_places, q_weights, places, weights in terms:
            a, b = np.searchsorted(places, [lo, hi])
            tile[np.ix_(places[a:b] - lo, q_places)] += weights[a:b, None] * q_weights[None, :]
    return out.T


def best(queries: Block, candidates: Block, k: int) -> Iterator[tuple[int, int, bool, int]]:
    """(place of the query, id, whether the id is there, score) of the k best of each query, with every tie
    that the order of ids could need."""
    table = scores(queries, candidates)
    for q in range(len(queries.ids)):
        row = table[q]
        free = np.flatnonzero((candidates.ids != queries.ids[q]) | ~candidates.has_id)
        if len(free) > k:
            bound = np.partition(row[free], len(free) - k)[len(free) - k]
            free = free[row[free] >= bound]
        order = np.lexsort((candidates.ids[free], ~candidates.has_id[free], -row[free]))[:k]
        for c in free[order].tolist():
            yield q, int(candidates.ids[c]), bool(candidates.has_id[c]), int(row[c])


def top_k(
    df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: float = SCALE
) -> DataFrame:
    """`query_id, rank, vec_id, score`: the k candidates of highest score for every query row."""
    rows = _usable(df.where(F.lit(True)), vec_id, vector)
    asked = _usable(df.where(is_query), vec_id, vector)
    candidates = pack_blocks(rows, CANDIDATES, scale)
    queries = pack_blocks(asked, QUERIES, scale)
    n_blocks, n_asked = (t.agg(F.coalesce(F.max("block") + 1, F.lit(0))).first()[0] for t in (candidates, queries))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A block of candidates is sent once for each group of query blocks, ahead of them; groups are there to keep all tasks busy.
    groups = max(1, min(n_asked, -(-tasks // max(n_blocks, 1))))
    packed = ["ids", "has_id", "lengths", "values"]

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>"))

    right = candidates.select("block", every(groups).alias("group"), F.lit(-1).alias("q_block"), *packed)
    left = queries.withColumnRenamed("block", "q_block").select(
        every(n_blocks).alias("block"), F.pmod("q_block", F.lit(groups)).alias("group"), "q_block", *packed
    )
    # Not a join: queries unfolded over all blocks look small to the planner, and it would broadcast them.
    meet = right.unionByName(left).repartition(max(tasks, n_blocks * groups), "block", "group").sortWithinPartitions("block", "group", "q_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for i in range(batch.num_rows):
                at, *parts = (batch.column(j)[i].as_py() for j in range(2, batch.num_columns))
                if at < 0:
                    block = Block(*parts)
                    continue
                asking = Block(*parts)
                found = list(best(asking, block, k))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([at] * len(found), pa.int32()), pa.array([f[0] for f in found], pa.int32()),
                        pa.array([int(asking.ids[f[0]]) for f in found], pa.int64()),
                        pa.array([f[1] if f[2] else None for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64()),
                    ],
                    names=["q_block", "place", "query_id", "vec_id", "score"],
                )

    found = meet.mapInArrow(run, "q_block int, place int, query_id long, vec_id long, score long")
    order = W.partitionBy("q_block", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def digest(df: DataFrame) -> DataFrame:
    """The five best of every row whose vec_id is divisible by 50."""
    return top_k(df, F.col("vec_id") % 50 == 0)
