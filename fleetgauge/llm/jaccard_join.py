"""Similarity join of texts on their word n-grams: MinHash banding, then checks on the full sets.

1. Each text becomes its set of n-word shingles (64-bit hashes; a text of fewer words is one
   shingle). Texts with equal sets are one *class member* from here on, however many rows they are.
2. `band_plan` chooses bands and rows for the recall wanted at the threshold. Members that share a
   band hash are candidates: each points to the smallest member of the bucket, which takes an
   aggregation and a join, so a bucket of any size is never gathered.
3. Candidates are looked at before they join anything: the low bytes of all MinHash values estimate a pair's
   similarity, and a pair below `LOOSE` is dropped. A member close to its bucket's smallest one (`TIGHT`) is done there,
   as whatever reaches the threshold with it is at least `LOOSE` to that smallest one; the others of a bucket are compared with
   each other the same way, in blocks. So texts that share a passage or a licence do not chain into one cluster.
4. The remaining candidates' graph falls into clusters. A cluster is cut into blocks of bounded size by hash,
   each pair of blocks is one unit of work, and all pairs in it whose sizes allow the similarity are
   checked on their full sets, whether they share a band or not. Units give back links per member and the edges of a spanning forest, never pairs.
5. The classes are the connected components of those edges.

The work on a cluster of texts that are all alike but all different grows with the square of its size, as
counting links does; it is dealt over units that share no key, and nothing of that size is stored.

Null and empty texts, and texts of white space, have no shingle and are in no pair: each is a class of its own
with 0 links. Rows with equal texts link to each other. A null id counts as larger than any other. Where one
id stands on different texts, each of those rows has its own class and links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.arrays import Flat, groups, mix, windows
from fleetgauge.llm.graph import components
from fleetgauge.llm.tables import add_columns, arrow_kinds
from fleetgauge.session import written

SHINGLE_WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
MAX_HASHES = 140
LOOSE = 0.4  # estimated similarity below which a candidate is none
TIGHT = 0.8  # estimated similarity from which on a member needs no comparison with the rest of its bucket
BLOCK_MEMBERS = 512
BLOCK_SHINGLES = 400_000


def band_plan(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have when `hashes` values are to find a pair at the
    threshold with the recall wanted. More rows make fewer false candidates."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))))
        if bands * rows > hashes:
            break  # more rows need more hashes still
        best = (bands, rows)
    return best


def _unique_per_text(keys: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each text in ascending order, and where each text begins."""
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    new = np.ones(len(keys), bool)
    new[1:] = (np.diff(keys) != 0) | (np.diff(text) != 0)
    keys, text = keys[new], text[new]
    return keys, np.searchsorted(text, np.arange(n_texts + 1))


def shingle_sets(texts: list[str | None], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(shingles, offsets) for groups of texts, in the order of the texts."""
    for _, some in groups(texts):
        flat = Flat(some)
        hashes = flat.word_hashes()
        text = flat.text_of_word()
        first, keys = windows(hashes, flat.word_offsets, n)
        owner = text[first]
        for size in range(1, n):  # texts too short for a window are one shingle
            short = np.flatnonzero(flat.counts == size)
            if len(short):
                at, more = windows(hashes, flat.word_offsets, size)
                mine = np.isin(text[at], short)
                keys = np.concatenate([keys, more[mine] + np.uint64(size)])
                owner = np.concatenate([owner, text[at][mine]])
        yield _unique_per_text(keys, owner, flat.n_texts)


def _factors(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def signatures(shingles: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes of each set, a row per set, and the low bytes of its MinHash values; sets must not be empty."""
    n = len(offsets) - 1
    out, low = np.zeros((n, bands), np.uint64), np.zeros((n, bands * rows), np.uint8)
    if not n:
        return out, low
    spread = shingles >> np.uint64(29)
    for k, factor in enumerate(_factors(bands * rows)):
        least = np.minimum.reduceat((shingles * factor) ^ spread, offsets[:-1])
        band = k // rows
        out[:, band] = mix(out[:, band] * np.uint64(31) + least + np.uint64(band + 1))
        low[:, k] = mix(least) & np.uint64(255)
    return out, low


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of sets from the low bytes of their MinHash values; unequal values agree in 1 of 256 bytes."""
    return ((a == b).mean(-1) - 1 / 256) / (1 - 1 / 256)


def set_keys(shingles: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """16 bytes that stand for a whole set: two independent sums over its shingles."""
    if len(offsets) < 2:
        return []
    one = np.add.reduceat(mix(shingles + np.uint64(11)), offsets[:-1])
    two = np.add.reduceat(mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)), offsets[:-1])
    return [bytes(x) for x in np.stack([one, two], 1).view("V16").ravel()]


def sketches(df: DataFrame, doc_id: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """`id, text_hash, key, n_shingles, bands, sketch` a row per row; key, bands and sketch are null without a word."""

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        keys, sizes, sigs, lows = [], [], [], []
        for shingles, offsets in shingle_sets(batch.column("_text").to_pylist(), n):
            count = np.diff(offsets)
            full = np.flatnonzero(count)
            at = np.append(offsets[:-1][full], offsets[-1])
            key = set_keys(shingles, at)
            sig, low = signatures(shingles, at, bands, rows)
            sig = sig.view(np.int64)
            made: list[tuple] = [(None, None, None)] * len(count)
            for i, k in enumerate(full.tolist()):
                made[k] = key[i], sig[i].tolist(), low[i].tobytes()
            for column, values in zip((keys, sigs, lows), zip(*made, strict=True), strict=True):
                column += values
            sizes += count.tolist()
        return {"key": keys, "n_shingles": sizes, "bands": sigs, "sketch": lows}

    rows_in = df.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("_text"))
    return add_columns(rows_in, work, {"key": "binary", "n_shingles": "int", "bands": "array<long>", "sketch": "binary"}, "_text").drop("_text")


def _candidates(members: DataFrame) -> DataFrame:
    """Edges `a, b` between members that share a bucket and look alike: enough of them to connect all that do."""
    spread = members.select("key", F.posexplode("bands").alias("band", "value"))
    bucket = spread.groupBy("band", "value").agg(F.min("key").alias("b"), F.count("*").alias("n")).where("n > 1")
    shared = written(spread.join(bucket.drop("n"), ["band", "value"]).where(F.col("key") != F.col("b")), "buckets")
    sketch = members.select("key", "sketch")
    pairs = shared.select(F.col("key").alias("a"), "b").distinct()
    met = pairs.join(sketch.withColumnsRenamed({"key": "a", "sketch": "_a"}), "a").join(
        written(sketch.join(bucket.select(F.col("b").alias("key")).distinct(), "key", "left_semi"), "heads")
        .withColumnsRenamed({"key": "b", "sketch": "_b"}),
        "b",
    )

    def look(batch: pa.RecordBatch) -> dict[str, object]:
        flat = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("_a", "_b")]
        return {"alike": estimated(*flat)}

    seen = written(add_columns(met.select("a", "b", "_a", "_b"), look, {"alike": "double"}, "_a", "_b").drop("_a", "_b"), "stars")
    edges = seen.where(F.col("alike") >= LOOSE).select("a", "b")
    # Members that are not close to their bucket's smallest one, with each other.
    loose = seen.where(F.col("alike") < TIGHT).select(F.col("a").alias("key"), "b")
    rest = shared.join(loose, ["key", "b"]).select(F.concat_ws(":", "band", "value").alias("cluster"), "key")
    crowded = rest.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1")
    blocks = crowded.select("cluster", F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int").alias("n_blocks"))
    placed = _in_blocks(rest.join(blocks, "cluster").join(sketch, "key"))

    def compare(rows: list[tuple], same: bool) -> Iterator[tuple]:
        side = np.array([r[0] for r in rows])
        flat = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        near = [(i, right[estimated(flat[i], flat[right]) >= LOOSE]) for i in left]
        i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([np.full(len(j), i) for i, j in near], [j for _, j in near]))
        root = _roots(len(rows), i, j)
        for k in np.flatnonzero(root != np.arange(len(rows))).tolist():
            yield rows[k][1], rows[root[k]][1]

    more = _units(placed.select("cluster", "block", "n_blocks", "key", "sketch"), compare, {"a": "binary", "b": "binary"})
    return edges.unionByName(more).distinct()


def _in_blocks(df: DataFrame) -> DataFrame:
    return df.withColumn("block", F.pmod(F.xxhash64("key"), F.col("n_blocks")).cast("int"))


def _blocks(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates with their cluster, block and number of blocks of the cluster."""
    clusters = components(edges).select(F.col("id").alias("key"), F.col("root").alias("cluster"))
    placed = written(members.drop("bands", "sketch").join(clusters, "key"), "clusters")
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.col("n_shingles").cast("long")).alias("s"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_MEMBERS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    return _in_blocks(placed.join(sizes.select("cluster", blocks.alias("n_blocks")), "cluster"))


def _with_sets(df: DataFrame, doc_id: str, text: str, placed: DataFrame, n: int) -> DataFrame:
    """Placed members with their shingle sets, made again from their texts.

    Rows that repeat one (id, text) give a member several times; units drop the repeats.
    """

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        sets = []
        for shingles, offsets in shingle_sets(batch.column("_text").to_pylist(), n):
            for k in range(len(offsets) - 1):
                sets.append(shingles[offsets[k] : offsets[k + 1]].tobytes())
        return {"shingles": sets}

    source = df.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    texts = source.join(
        placed, source["_id"].eqNullSafe(placed["id"]) & (source["_hash"] == placed["text_hash"])
    ).select("key", "cluster", "block", "n_blocks", "copies", "_text")
    return add_columns(texts, work, {"shingles": "binary"}, "_text").drop("_text")


def _pairs_to_check(size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs can reach the threshold: the intersection is no larger than the smaller set, the union no smaller than the larger."""
    a, b = size_a[:, None], size_b[None, :]
    return np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9


_COLUMNS = 4096  # shingles multiplied at once


def _intersections(a: list[np.ndarray], b: list[np.ndarray], same: bool) -> np.ndarray:
    """Sizes of the intersections of every set of `a` with every set of `b`; when both are the `same` sets, off the diagonal.

    Only shingles that occur on both sides (in two sets, when they are the same) count; they become columns of two 0/1 matrices, whose
    product is summed over slices of columns.
    """
    rows_a, rows_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    if same:
        common, times = np.unique(flat_a, return_counts=True)
        common = common[times > 1]
    else:
        common = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.float32)
    place = lambda flat: np.searchsorted(common, flat)
    hold_a, hold_b = np.isin(flat_a, common), np.isin(flat_b, common)
    col_a, rows_a = place(flat_a[hold_a]), rows_a[hold_a]
    col_b, rows_b = place(flat_b[hold_b]), rows_b[hold_b]
    order_a, order_b = np.argsort(col_a, kind="stable"), np.argsort(col_b, kind="stable")
    col_a, rows_a, col_b, rows_b = col_a[order_a], rows_a[order_a], col_b[order_b], rows_b[order_b]
    for lo in range(0, len(common), _COLUMNS):
        hi = min(lo + _COLUMNS, len(common))
        slices = []
        for col, row, n in ((col_a, rows_a, len(a)), (col_b, rows_b, len(b))):
            i, j = np.searchsorted(col, [lo, hi])
            m = np.zeros((n, hi - lo), np.float32)
            m[row[i:j], col[i:j] - lo] = 1
            slices.append(m)
        out += slices[0] @ slices[1].T  # whole numbers below 2^24 are exact
    return out


def _linked(a: list[np.ndarray], b: list[np.ndarray], check: np.ndarray, threshold: float, same: bool) -> np.ndarray:
    """Which of the pairs to check have at least the similarity wanted, on their full sets.

    When `a` and `b` are the `same` sets, `check` is symmetric and leaves the diagonal out.
    """
    out = np.zeros(check.shape, bool)
    n_check = int(check.sum())
    if not n_check:
        return out
    use_a, use_b = np.flatnonzero(check.any(1)), np.flatnonzero(check.any(0))
    if n_check * 4 < len(use_a) * len(use_b) or max(map(len, a)) >= 1 << 24:
        for i, j in np.argwhere(check).tolist():
            both = len(np.intersect1d(a[i], b[j], assume_unique=True))
            out[i, j] = both >= threshold * (len(a[i]) + len(b[j]) - both) - 1e-9
        return out
    part_a, part_b = [a[i] for i in use_a], [b[j] for j in use_b]
    both = _intersections(part_a, part_b, same).astype(np.float64)
    sizes = np.array([len(x) for x in part_a])[:, None] + np.array([len(x) for x in part_b])[None, :]
    out[np.ix_(use_a, use_b)] = both >= threshold * (sizes - both) - 1e-9
    return out & check


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each place over the edges."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low


def compare_unit(rows: list[tuple], same: bool, threshold: float) -> Iterator[tuple[bytes, bytes, int]]:
    """(key, key of its local root, links) of the members of one unit that have a link.

    `rows`: (side, key, copies, shingles); `same` when both sides are one block.
    """
    keys, copies, sets, sides = [], [], [], []
    seen = set()
    for side, key, n, shingles in rows:
        if key not in seen:
            seen.add(key)
            keys.append(key)
            copies.append(n)
            sets.append(np.frombuffer(shingles, np.uint64))
            sides.append(side)
    side = np.array(sides)
    left = np.arange(len(keys)) if same else np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    if not len(left) or not len(right) or len(keys) < 2:
        return
    size = np.array([len(x) for x in sets])
    check = _pairs_to_check(size[left], size[right], threshold)
    if same:
        np.fill_diagonal(check, False)
    found = _linked([sets[k] for k in left], [sets[k] for k in right], check, threshold, same)
    weight = np.array(copies, np.int64)
    links = np.zeros(len(keys), np.int64)
    links[left] += found @ weight[right]
    if not same:
        links[right] += found.T @ weight[left]
    i, j = np.nonzero(found)
    root = _roots(len(keys), left[i], right[j])
    for k in np.flatnonzero(links).tolist():
        yield keys[k], keys[root[k]], int(links[k])


def _units(placed: DataFrame, compare: Callable[[list[tuple], bool], Iterator[tuple]], kinds: dict[str, str]) -> DataFrame:
    """What `compare` gives of every unit, a pair of blocks of one cluster.

    `placed`: `cluster, block, n_blocks` and more, which `compare` gets as rows led by the side (0 or 1), with
    whether both sides are one block.
    """
    more = [c for c in placed.columns if c not in ("cluster", "block", "n_blocks")]
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("o")
    spread = placed.select("cluster", "block", *more, other).select(
        "cluster", F.least("block", "o").alias("p"), F.greatest("block", "o").alias("q"),
        (F.col("block") > F.col("o")).cast("int").alias("side"), *more,
    )
    unit = ["cluster", "p", "q"]
    types = arrow_kinds(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def flush() -> pa.RecordBatch:
            out = list(compare(held, at[1] == at[2]))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types.values())], names=list(types))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != at:
                    if held:
                        yield flush()
                    held, at = [], row[:3]
                held.append(row[3:])
        if held:
            yield flush()

    laid = spread.repartition(*unit).sortWithinPartitions(*unit)
    return laid.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))


def similarity_classes(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, words: int = SHINGLE_WORDS,
    threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = MAX_HASHES,
) -> DataFrame:
    """`id, text_hash, class_id, n_links, first`, a row per row of `df`.

    `class_id`: smallest id of the class; `n_links`: other rows with at least the similarity wanted;
    `first`: true for all rows with the id and text that stand for the class.
    """
    bands, rows = band_plan(threshold, recall, hashes)
    all_rows = written(sketches(df, doc_id, text, words, bands, rows), "sketches")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    members = written(
        all_rows.where("key is not null").groupBy("key").agg(
            F.min(order).alias("o"), F.count("*").alias("copies"),
            F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
        ).select("key", "o.id", "o.text_hash", "o.none", "copies", "n_shingles", "bands", "sketch"),
        "members",
    )
    edges = written(_candidates(members), "candidates")
    placed = written(_blocks(members, edges), "placed")
    sets = _with_sets(df, doc_id, text, placed, words).select("cluster", "block", "n_blocks", "key", "copies", "shingles")
    found = written(
        _units(sets, lambda unit, same: compare_unit(unit, same, threshold), {"key": "binary", "root": "binary", "links": "long"}), "found"
    )
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    forest = found.select(F.col("key").alias("a"), F.col("root").alias("b"))
    roots = components(forest).select(F.col("id").alias("key"), "root")
    linked = written(placed.select("key", "id", "text_hash", "none").join(roots, "key").join(links, "key"), "linked")
    heads = linked.groupBy("root").agg(F.min(F.struct("none", "id", "text_hash")).alias("head"))
    of_key = linked.join(heads, "root").select("key", "head", "links")
    own = members.select("key", F.struct("none", "id", "text_hash").alias("own"), "copies")
    classes = own.join(of_key, "key", "left").select(
        "key", F.coalesce("head", "own").alias("head"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = all_rows.select("id", "text_hash", "key").join(classes, "key", "left")
    # A row without a word is its own class.
    lone = F.col("key").isNull()
    return out.select(
        "id", "text_hash",
        F.when(lone, F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (lone | (F.col("head.id").eqNullSafe(F.col("id")) & (F.col("head.text_hash") == F.col("text_hash")))).alias("first"),
    )


def digest(df: DataFrame) -> DataFrame:
    """`doc_id, class_id, n_links` of every row of `documents`."""
    return similarity_classes(df).select(F.col("id").alias("doc_id"), "class_id", "n_links")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with its own columns, whatever their names: that with the smallest id."""
    chosen = written(
        similarity_classes(df, doc_id, text).where("first").groupBy("id", "text_hash").agg(F.count("*").alias("n")), "chosen"
    )
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{doc_id}`").alias("own_id"), F.xxhash64(f"`{text}`").alias("own_hash")
    )
    # The ids grow with the rows, so they are not sent to every task, however few they are.
    met = rows.join(chosen.hint("merge"), rows["own_id"].eqNullSafe(chosen["id"]) & (rows["own_hash"] == chosen["text_hash"]))
    once = met.where("n = 1").select("row.*")
    if chosen.where("n > 1").isEmpty():
        return once
    # Rows that repeat id and text: one of them.
    again = met.where("n > 1").groupBy("id", "text_hash").agg(F.first("row").alias("row"))
    return once.unionByName(again.select("row.*"))
