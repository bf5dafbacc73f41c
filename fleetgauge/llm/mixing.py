"""Mixing sources to target weights by weighted fair queueing.

Every document of a source stands at a shuffled place (the order of an MD5 of its id and a seed).
The e-th repeat of a document has the virtual finish time
`(e * size of the source + sizes up to and with the document) / target of the source`.
All repeats of all sources are sorted by that time, over ranges, and taken until the total budget
is reached. A source with a larger target has smaller steps, so it is served more often.

Targets: weights share the budget; no target exceeds `repeats` times its source's size, and what
a source can't take goes to the others by weight. The level of that sharing has a closed form over
the sources in the order of (largest target / weight).

Sums run over ranges: a sorted table is written, each part of it is summed, and the parts' starts
are added up over one row per part and source, so no source is ever in one task.

A null source is a source of its own, last in order. Null texts have size 0; documents of size 0
take nothing. Repeated rows count and are taken one by one. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetgauge.session import written

WEIGHTS = (5, 2, 1)
REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def running_sum(df: DataFrame, order: list[str], value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """`df` with the sum of `value` up to and with each row, in the order, within equal `by`.

    `by` has to lead the order. The one window without a key runs over a row per part of the
    sorted table and per `by` in it, which the parts and sources bound.
    """
    by = by or []
    laid = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order]).withColumn("_part", F.spark_partition_id())
    laid = written(laid, "ranges")
    inside = W.partitionBy("_part", *by).orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(W.unboundedPreceding, 0)
    parts = laid.groupBy("_part", *by).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select(
        F.col("_part").alias("_p"), *[F.col(c).alias(f"_by_{c}") for c in by], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start")
    )
    match = laid["_part"] == starts["_p"]
    for c in by:
        match = match & laid[c].eqNullSafe(starts[f"_by_{c}"])
    return laid.withColumn("_inside", F.sum(value).over(inside)).join(starts, match).select(
        *df.columns, (F.col("_inside") + F.col("_start")).cast("long").alias(name)
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, share: float = 1.0) -> DataFrame:
    """`source, source_size, rank, target` from `source, source_size`.

    The sources are numbered by code point, null last, and take their weights in turn.
    """
    ranked = running_sum(sizes.withColumn("_one", F.lit(1)), ["source"], "_one", "rank").drop("_one")
    at = (F.col("rank") - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (at + 1).cast("int")).cast("long")
    cap = F.col("source_size") * repeats
    full = ranked.select("source", "source_size", "rank", weight.alias("w"), cap.alias("cap")).withColumn(
        "ratio", F.col("cap").cast("double") / F.col("w")
    )
    total = full.agg(F.sum("source_size"), F.sum("w")).first()
    if total[0] is None:
        return full.select("source", "source_size", "rank", F.lit(0.0).alias("target"))
    budget, all_weights = float(total[0]) * share, total[1]
    # With the first k sources at their caps, the others get (budget - caps) / (weights left) each
    # per unit of weight; the level is that of the first k at which nobody else is above the cap.
    capped = running_sum(full, ["ratio", "rank"], "cap", "caps")
    summed = running_sum(capped, ["ratio", "rank"], "w", "ws")
    level = (F.lit(budget) - (F.col("caps") - F.col("cap"))) / (F.lit(all_weights) - (F.col("ws") - F.col("w")))
    first = summed.select(level.alias("level"), "ratio").where("level <= ratio").agg(F.min(F.struct("ratio", "level")).alias("m")).first()
    found = first["m"]["level"] if first["m"] is not None else float("inf")
    return full.select(
        "source", "source_size", "rank", F.least(F.col("cap").cast("double"), F.col("w") * F.lit(found)).alias("target")
    )


def mix(
    df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", *,
    weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = "mix",
) -> DataFrame:
    """`doc_id, source, size, source_size, target, taken`, a row per row of `df`."""
    shuffle = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(seed)))
    sized = written(
        df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), shuffle.alias("place"), word_count(text).alias("size")),
        "sizes",
    )
    sources = written(
        source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats), "targets"
    )
    placed = running_sum(sized, ["source", "place", "doc_id", "size"], "size", "cum", by=["source"])
    known = sources.select(F.col("source").alias("_source"), "source_size", "rank", "target")
    queue = written(
        placed.join(known, placed["source"].eqNullSafe(known["_source"])).drop("_source", "place"), "queue"
    )
    last = _last_taken(queue, repeats)
    taken = F.lit(0).cast("long")
    for e in range(repeats):
        if last is not None:
            v = _finish(e)
            inside = (v < F.lit(last["v"])) | ((v == F.lit(last["v"])) & (F.col("rank") <= F.lit(last["rank"])))
            taken = taken + F.when((F.col("size") > 0) & (F.col("target") > 0) & inside, F.col("size")).otherwise(F.lit(0))
    return queue.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def _finish(repeat: int | Column) -> Column:
    e = repeat if isinstance(repeat, Column) else F.lit(repeat)
    return (e * F.col("source_size") + F.col("cum")).cast("double") / F.when(F.col("target") > 0, F.col("target"))


def _last_taken(queue: DataFrame, repeats: int):
    """Finish time and source of the last repeat that the budget holds, or None."""
    total = queue.agg(F.sum("size")).first()[0]
    if not total:
        return None
    items = (
        queue.where("size > 0 and target > 0").withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .select(_finish(F.col("e")).alias("v"), "rank", "size")
    )
    run = running_sum(items, ["v", "rank"], "size", "run")
    return run.where(F.col("run") <= F.lit(total)).agg(F.max(F.struct("v", "rank")).alias("m")).first()["m"]


def digest(df: DataFrame) -> DataFrame:
    """`doc_id, size, source_size, target, taken` of every row of `documents`."""
    return mix(df).select("doc_id", "size", "source_size", "target", "taken")


def take(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of the mix with their own columns, whatever their names, a document as often as it is taken."""
    taken = mix(df, doc_id, source, text).where("taken > 0")
    # Rows that repeat one (id, source, size) are told apart by their number among equals.
    same = taken.groupBy("doc_id", "source", "size").agg(
        F.sum((F.col("taken") / F.col("size")).cast("int")).alias("times"), F.count("*").alias("equal")
    )
    same = written(same, "taken")
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{doc_id}`").alias("own_id"),
        F.col(f"`{source}`").alias("own_source"), word_count(f"`{text}`").alias("own_size"),
    )
    match = (
        rows["own_id"].eqNullSafe(same["doc_id"]) & rows["own_source"].eqNullSafe(same["source"]) & (rows["own_size"] == same["size"])
    )
    met = rows.join(same.hint("merge"), match)  # grows with the rows: not sent to every task, however small it is
    copies = lambda rows, n: rows.select("row", F.explode(F.sequence(F.lit(1), n)).alias("n")).select("row.*")
    once = copies(met.where("equal = 1"), F.col("times"))
    if same.where("equal > 1").isEmpty():
        return once
    # Equal rows share what they take: each gets the whole part of it, the first ones one more.
    nth = F.row_number().over(W.partitionBy("doc_id", "source", "size").orderBy(F.xxhash64("row")))
    again = met.where("equal > 1").withColumn("nth", nth)
    each = F.floor(F.col("times") / F.col("equal")) + F.when(F.col("nth") <= F.col("times") % F.col("equal"), 1).otherwise(0)
    return once.unionByName(copies(again.withColumn("each", each.cast("int")).where("each > 0"), F.col("each")))
