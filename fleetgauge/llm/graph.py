"""Connected components of a graph whose nodes mostly hang on few others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.session import written


def components(edges: DataFrame) -> DataFrame:
    """`id, root` of every end of the edges `a, b`: the smallest id that can be reached.

    Edges are pointed from the larger to the smaller end. What a node points to is linked to the smallest of
    these, so nodes that nothing points to (members of a bucket, say) need one edge and leave the graph before the
    rounds; they take the root of what they point to. Edges of a node to itself count as none but keep the node.
    """
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    way = written(ends, "ways")
    first = written(way.where("a != b").groupBy("a").agg(F.min("b").alias("p")), "first")
    inner = written(way.select(F.col("b").alias("id")).distinct(), "inner")
    across = way.join(first, "a").where(F.col("b") != F.col("p")).where("a != b").select(F.col("b").alias("a"), F.col("p").alias("b"))
    own = first.join(inner.withColumnRenamed("id", "a"), "a", "left_semi").select("a", F.col("p").alias("b"))
    heads = _labels(inner, across.unionByName(own))
    outer = first.join(inner.withColumnRenamed("id", "a"), "a", "left_anti")
    hung = outer.join(heads.withColumnsRenamed({"id": "p"}), "p").select(F.col("a").alias("id"), "root")
    return heads.unionByName(hung)


def _labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`id, root`: rounds take the smallest root among the neighbours and then that root's root, so their number
    grows with the logarithm of the longest path. A round ends in a written table."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "links")
    state = nodes.select("id", F.col("id").alias("root"))
    while True:
        near = both.join(state.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = written(
            state.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root")),
            "lower",
        )
        jump = lower.select(F.col("id").alias("root"), F.col("root").alias("far"))
        moved = written(lower.join(jump, "root").select("id", "old", F.least("root", "far").alias("root")), "roots")
        state = moved.select("id", "root")
        if moved.where(F.col("root") != F.col("old")).isEmpty():
            return state
