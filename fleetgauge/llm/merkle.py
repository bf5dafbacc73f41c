"""Merkle manifest of a dataset: a hash tree over its rows by lag and lead windows.

Leaves stand in groups, and in each group at consecutive positions. Two consecutive nodes of a level
make their parent, the hash of both; a last node without a neighbour makes a parent alone, until one
node is left. The tops of the groups, in the order of their keys, are the leaves of one more tree,
whose top is the root.

A level needs no join: the node of 2^l leaves lives on the row of its first leaf, so the neighbour's
row lies at the fixed offset 2^l. `lag` and `lead` by that offset, masked by the slot (which child the
node is) and by the length of the run, give the sibling, and first-child rows hash the parents. Windows
run over blocks of 2^10 positions; the tops of the blocks are the leaves of the next round, so a group
of any size is many blocks, and the rounds shrink a thousandfold. On the way down, each row's list of
steps (sibling, and whether it stands on the left) is lengthened by that of its block, where the
windows have already laid the rows.

A null in any column is hashed as `-`. Rows with equal keys and ids stand in the order of their hashes;
null ids come last, the null group first. An empty table has no tree and gives an empty result. Columns
other than those named play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetgauge.llm.mixing import running_sum
from fleetgauge.session import written

LEVELS = 10  # levels of one round: a block has 2^LEVELS positions
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<sibling:string,on_left:boolean>>"


def field(value: Column) -> Column:
    """`-` for null, else length in bytes, `:` and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def tampers(doc_id: Column, every: int = 7) -> Column:
    """Whether the row is one of those tampered with: `every` divides the checksum of its id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % every == 0, F.lit(False))


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """`leaves` (with `grp`, never null) and their position `pos`, from 0, in the group."""
    counted = running_sum(leaves.withColumn("one", F.lit(1)), ["grp", *order], "one", "nth", by=["grp"])
    return written(counted.withColumn("pos", F.col("nth") - 1).drop("one", "nth"), "leaves")


def _climb(nodes: DataFrame, steps: bool) -> DataFrame:
    """`nodes` (`grp, pos, node`) with `block` and the block's top in `node` on its first row; with
    `steps`, every row keeps its `node` and has the steps from it to the block's top."""
    rows = nodes.withColumn("block", F.shiftright("pos", LEVELS)).withColumn("h", F.col("node"))
    order = W.partitionBy("grp", "block").orderBy("pos")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    # Only the first block can be the whole group; a group with more blocks has a run at every level here.
    length = F.when(F.col("block") == 0, F.count(F.lit(1)).over(W.partitionBy("grp", "block"))).otherwise(2 << LEVELS)
    rows = rows.withColumn("length", length)
    taken = []
    for level in range(LEVELS):
        size = 1 << level
        first = F.pmod("pos", F.lit(size)) == 0
        slot = F.shiftright("pos", level).bitwiseAND(F.lit(1).cast("long"))
        several = F.col("length") > size
        before, after = F.lag("h", size).over(order), F.lead("h", size).over(order)
        around = rows.select("*", *([before.alias("before")] if steps else []), after.alias("after"))
        right = F.coalesce(F.when(several, F.col("after")), F.lit(""))
        made = F.when(several, F.sha2(F.concat("h", right), 256)).otherwise(F.col("h"))
        parent = F.when(first & (slot == 0), made)
        if steps:
            mine = F.when(several, F.when(slot == 1, F.col("before")).otherwise(right))
            found = around.select("*", F.when(first, mine).alias("found")).drop("before")
            held = F.last("found", ignorenulls=True).over(so_far)  # the node's first row gives it to the others
            step = F.when(several, F.struct(held.alias("sibling"), (slot == 1).alias("on_left")))
            rows = found.select("*", step.alias(f"step{level}"), parent.alias("up"))
            taken.append(f"step{level}")
            rows = rows.drop("h", "after", "found").withColumnRenamed("up", "h")
        else:
            rows = around.withColumn("h", parent).drop("after")
    if steps:
        return rows.withColumn("steps", F.filter(F.array(*taken), lambda s: s.isNotNull())).drop("h", "length", *taken)
    return rows.drop("node", "length").withColumnRenamed("h", "node")


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """The leaves, then the tops of the blocks of each round, until each group is one node."""
    rounds = [nodes]
    while True:
        tops = _climb(rounds[-1].select("grp", "pos", "node"), steps=False)
        tops = tops.where(F.pmod("pos", F.lit(1 << LEVELS)) == 0).select("grp", F.col("block").alias("pos"), "node")
        rounds.append(written(tops, "tops"))
        if not rounds[-1].agg(F.max("pos")).first()[0]:
            return rounds


def _down(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with all their steps; `above` holds `grp, pos, steps` of the last round, and columns to hand down."""
    for k, nodes in enumerate(reversed(rounds[:-1])):
        over = above.withColumnsRenamed({"pos": "block", "steps": "more"}).drop("node")
        joined = _climb(nodes, steps=True).join(over, ["grp", "block"])
        above = joined.withColumn("steps", F.concat("steps", "more")).drop("more", "block")
        if k < len(rounds) - 2:
            above = written(above, "steps")
    return above


def proofs(leaves: DataFrame, order: list[str]) -> DataFrame:
    """`leaves` (`grp, node` and more) with `steps`, `subroot` and `root`.

    `grp` must not be null; groups take part in the upper tree in the order of `grp`, leaves in that of `order`.
    """
    rounds = _rounds(placed(leaves, order))
    groups = placed(rounds[-1].select(F.lit("").alias("grp"), F.col("grp").alias("key"), "node"), ["key"])
    upper = _rounds(groups)
    none = F.array().cast(_STEP)
    root = upper[-1].select("grp", "pos", F.col("node").alias("root"), none.alias("steps"))
    tops = _down(upper, root).select(F.col("key").alias("grp"), "steps", F.col("node").alias("subroot"), "root")
    above = written(rounds[-1].select("grp", "pos").join(tops, "grp"), "steps")
    return _down(rounds, above)


def proof_hash(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: s["sibling"]), ""), 256)


def fold(node: Column, steps: Column) -> Column:
    """Root that follows from a leaf and its steps."""
    both = lambda h, s: F.when(s["on_left"], F.concat(s["sibling"], h)).otherwise(F.concat(h, s["sibling"]))
    return F.aggregate(steps, node, lambda h, s: F.sha2(both(h, s), 256))


def manifest(
    df: DataFrame, columns: tuple[str, ...] = COLUMNS, doc_id: str = "doc_id", group: str = "lang",
    changed: str = "n_chars", every: int = 7,
) -> DataFrame:
    """`doc_id, <group>, leaf, steps, subroot, root, proof_sha256, folded_root, verified` a row per row of `df`.

    `folded_root` starts from a leaf whose `changed` column is one more where `tampers` says so.
    """
    col = lambda name: F.col(f"`{name}`")
    wrong = F.when(
        tampers(col(doc_id), every) & col(changed).isNotNull(),
        leaf_hash(*[col(c) + 1 if c == changed else col(c) for c in columns]),
    )
    key = F.coalesce(F.concat(F.lit("+"), col(group).cast("string")), F.lit(""))  # null first, then bytewise
    leaves = df.select(
        key.alias("grp"), col(doc_id).alias("doc_id"), leaf_hash(*[col(c) for c in columns]).alias("node"), wrong.alias("wrong")
    )
    rows = proofs(leaves, ["doc_id", "node"])
    rows = rows.withColumn("folded_root", fold(F.coalesce("wrong", "node"), F.col("steps")))
    return rows.select(
        "doc_id", F.when(F.col("grp") != "", F.expr("substring(grp, 2)")).alias(group), F.col("node").alias("leaf"), "steps",
        "subroot", "root", proof_hash(F.col("steps")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def digest(df: DataFrame) -> DataFrame:
    return manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
