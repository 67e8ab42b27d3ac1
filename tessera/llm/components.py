"""Connected components of an edge table, by alternating stars.

Each round rewrites the edges so that every node points to a smaller one: the
large star links a node's larger neighbours to its minimum, the small star links
the smaller ones.  Rounds grow with the logarithm of a component's size.  The
edges never leave the executors; each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.scratch import discard, materialize


def _least(pairs: DataFrame) -> DataFrame:
    """The least v of every u, as a plain table: joined with another, adaptive execution can split a hot node."""
    return materialize(pairs.groupBy("u").agg(F.min("v").alias("m")), "star-least")


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """edges (u, v) -> (node, root): root is the least node reachable.

    Only nodes with an edge to another node are returned; direction, self loops and
    repeated edges don't matter, and rows with a null end are ignored.  An empty
    table gives an empty one.
    """
    pairs = edges.select("u", "v").where("u <> v")
    pairs = materialize(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = (0, None)
    for _ in range(max_rounds):
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        # Large star: the larger neighbours of a node go to its least neighbour, or to itself.
        last = pairs
        least = _least(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = pairs.join(least.select(F.col("u").alias("v"), "m"), "v").select("u", F.least("v", "m").alias("v"))
        large = materialize(large, "large-star")
        # Small star: the smaller neighbours of a node, and the node, go to the least of them.
        nearest = _least(large)
        hooked = large.join(nearest, "u")
        small = hooked.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "small-star")
        discard(last, least, large, nearest)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def merge_groups(members: DataFrame) -> DataFrame:
    """(node, root) with a row for each group that a node is in -> (node, root), a row per node.

    Groups that share a node are one; root is the least root of all groups so joined.  A
    node must be in few groups (its groups meet in one row), a group may have any size.
    """
    own = materialize(members.groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots")), "grouped")
    links = own.where(F.size("roots") > 1).select(F.col("root").alias("u"), F.explode("roots").alias("v"))
    heads = materialize(connected_components(links), "group-heads").select(F.col("node").alias("root"), F.col("root").alias("head"))
    return own.select("node", "root").join(heads, "root", "left").select("node", F.coalesce("head", "root").alias("root"))
