"""Recursive traversal, shortest paths and PageRank over edge tables.

Python drives the iterations, Spark does each step; every step is a written table, so
plans stay small and a lost executor costs no earlier step.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce
from itertools import count, islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.pieces_of_graph import ranks, stars
from tessera.scratch import materialize
from tessera.session import share_package

#: Steps after which a recursive query ends; nothing else does.
MAX_STEPS = 1000
#: Edges that a task holds at once; components with more are ranked in rounds over the cluster.
PIECE_EDGES = 1 << 20


def _unseen(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys were not seen; NULL equals NULL."""
    known = seen.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same: Column = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return rows.join(known, same, "left_anti")


def recursive_frontier(
    base: DataFrame, step: Callable[[DataFrame, int], DataFrame], keys: list[str] | None = None, max_steps: int | None = MAX_STEPS
) -> DataFrame:
    """base UNION step(frontier) UNION step(...) with rows deduplicated against all seen.

    ``step`` gets the last new rows and the depth of what it makes (the base has depth 1).
    ``keys`` are the columns that make a row new, all by default, so cycles end.  Without
    ``max_steps`` it runs until nothing is new; the default is that of recursive queries,
    and reaching it warns.
    """
    keys = keys or base.columns
    frontier = materialize(base.dropDuplicates(keys), "frontier")
    parts = [frontier]
    for depth in islice(count(2), max_steps):
        seen = reduce(DataFrame.unionByName, parts)
        frontier = materialize(_unseen(step(frontier, depth).select(*base.columns).dropDuplicates(keys), seen, keys), "frontier")
        if frontier.isEmpty():
            break
        parts.append(frontier)
        if len(parts) >= 32:
            parts = [materialize(reduce(DataFrame.unionByName, parts), "seen")]
    else:
        if max_steps == MAX_STEPS:
            warnings.warn(f"the recursion was ended after {MAX_STEPS} steps", RuntimeWarning, stacklevel=2)
    return reduce(DataFrame.unionByName, parts)


def edges_of(df: DataFrame, src: str, dst: str) -> DataFrame:
    """(src, dst) as bigint; edges with a NULL end are left out."""
    return df.select(F.col(src).cast("bigint").alias("src"), F.col(dst).cast("bigint").alias("dst")).dropna()


def k_hop(edges: DataFrame, starts: DataFrame, hops: int | None = None) -> DataFrame:
    """starts (node) -> (node, depth): nodes within some hops, or any number, with the least number of them."""
    base = starts.select(F.col("node").cast("bigint").alias("node"), F.lit(0).alias("depth"))

    def step(frontier: DataFrame, depth: int) -> DataFrame:
        return frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node"), F.lit(depth - 1).alias("depth"))

    return recursive_frontier(base, step, ["node"], hops)


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int | None = None) -> DataFrame:
    """pairs (source, target) -> (source, target, hops): directed and unweighted; 0 for itself, NULL if unreachable.

    Without ``max_hops`` the search ends only when nothing new is reached.  All sources advance together; a source stops when its targets are found.
    """
    pairs = materialize(pairs.select(F.col("source").cast("bigint").alias("source"), F.col("target").cast("bigint").alias("target")).distinct(), "pairs")
    edges = materialize(edges.distinct(), "edges")
    frontier = materialize(pairs.select("source", F.col("source").alias("node"), F.lit(0).alias("hops")).distinct(), "frontier")
    reached, found, open_pairs = [frontier], [], pairs
    for hops in islice(count(), None if max_hops is None else max_hops + 1):
        hit = open_pairs.join(frontier.select("source", F.col("node").alias("target"), "hops"), ["source", "target"])
        found.append(hit)
        open_pairs = materialize(open_pairs.join(frontier.select("source", F.col("node").alias("target")), ["source", "target"], "left_anti"), "open-pairs")
        active = open_pairs.select("source").distinct()
        ahead = frontier.join(active, "source").join(edges, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node"), F.lit(hops + 1).alias("hops")).distinct()
        frontier = materialize(_unseen(ahead, reduce(DataFrame.unionByName, reached), ["source", "node"]), "frontier")
        if frontier.isEmpty():
            break
        reached.append(frontier)
        if len(reached) >= 32:
            reached = [materialize(reduce(DataFrame.unionByName, reached), "reached")]
    return pairs.join(reduce(DataFrame.unionByName, found), ["source", "target"], "left")


def pagerank(edges: DataFrame, iterations: int = 20, damping: float = 0.85, every: int = 5) -> DataFrame:
    """(node, rank) after a fixed number of iterations, from 1/N; edges with a NULL end are left out.

    Parallel edges count as often as they come, and the rank of nodes without out-edges
    is not handed on.  So components have no part in each other's ranks but for N: each is
    ranked in the memory of a task, and only those too large for that in rounds.
    """
    pieces, nodes, found = _contracted(edges, True)
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    own = _component(pieces.where("dst IS NOT NULL"), found)
    large = materialize(own.groupBy("component").agg(F.count("*").alias("edges")).where(F.col("edges") > PIECE_EDGES).select("component"), "large")
    if some := not large.isEmpty():
        own = materialize(own, "component-edges")
    small = own.join(large, "component", "left_anti").select("src", "dst", "component") if some else own.select("src", "dst", "component")
    run = ranks(PIECE_EDGES, n, iterations, damping)
    ranked = small.repartition("component").sortWithinPartitions("component").mapInArrow(run, "node bigint, rank double")
    return ranked.unionByName(_ranked_in_rounds(own.join(large, "component", "left_semi").select("src", "dst"), n, iterations, damping, every)) if some else ranked


def _ranked_in_rounds(edges: DataFrame, n: int, iterations: int, damping: float, every: int) -> DataFrame:
    """(node, rank) of the edges' nodes, among ``n`` in all."""
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    shares = edges.groupBy("src", "dst").agg(F.count("*").alias("n")).join(degree, "src").select("src", "dst", (F.col("n") / F.col("degree")).alias("share"))
    nodes = materialize(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "nodes")
    # An edge of no weight from each node to itself: so every node is in the sums, which then need no other join.
    loops = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("share"))
    weighted = materialize(shares.unionByName(loops), "shares")
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    for i in range(1, iterations + 1):
        got = rank.join(weighted, rank.node == weighted.src).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = got.select(F.col("dst").alias("node"), (F.lit((1 - damping) / n) + damping * F.col("got")).alias("rank"))
        if i % every == 0:
            rank = materialize(rank, "ranks")
    return rank


def _contracted(edges: DataFrame, with_edges: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Pieces (src, dst, root), nodes (node, root) and, where pieces share nodes, the roots' (node, component).

    Tasks find the components of their pieces in memory.  A node of several pieces ties
    their roots; those ties are a graph with an edge at most for each time that a node comes
    again, and none if each component lies in one piece.
    """
    share_package(edges.sparkSession)
    edges = edges.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")).dropna()
    pieces = materialize(edges.mapInArrow(stars(PIECE_EDGES, with_edges), "src bigint, dst bigint, root bigint"), "pieces")
    ends = pieces.where("dst IS NULL").select(F.col("src").alias("node"), "root")
    nodes = materialize(ends.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("other")), "nodes")
    again = nodes.where("root < other")
    if again.isEmpty():
        return pieces, nodes.select("node", "root"), None
    ties = ends.withColumnRenamed("root", "src").join(again.select("node", F.col("root").alias("dst")), "node").where("src <> dst")
    ties = materialize(ties.select("src", "dst").distinct(), "ties")
    n = ties.count()
    if n <= PIECE_EDGES:
        found = materialize(ties.coalesce(1).mapInArrow(stars(n + 1, False), "src bigint, dst bigint, root bigint").select(F.col("src").alias("node"), F.col("root").alias("component")), "roots")
    else:
        found = weakly_connected(ties) if n < nodes.count() // 4 else _propagated(ties)
    return pieces, nodes.select("node", "root"), found


def _component(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """Rows with a root, with the root's component in its place."""
    if found is None:
        return rows.withColumnRenamed("root", "component")
    names = [c for c in rows.columns if c != "root"]
    heads = found.select(F.col("node").alias("root"), "component")
    return rows.join(heads, "root", "left").select(*names, F.coalesce("component", "root").alias("component"))


def weakly_connected(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, ignoring direction; edges with a NULL end are left out."""
    _, nodes, found = _contracted(edges, False)
    return _component(nodes, found)


def _propagated(edges: DataFrame) -> DataFrame:
    """(node, component) by label propagation with pointer jumps, for edges that pieces of memory bring no nearer."""
    both = materialize(edges.union(edges.select("dst", "src")).where("src <> dst").distinct(), "edges-both")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    label = materialize(nodes.withColumn("component", F.col("node")), "labels")
    while True:
        near = both.join(label, both.dst == label.node).groupBy("src").agg(F.min("component").alias("near"))
        moved = label.join(near, label.node == near.src, "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("was"))
        moved = materialize(moved, "labels")
        if moved.where("component <> was").isEmpty():
            return moved.select("node", "component")
        # Pointer jump: the label of the label.
        jump = moved.select(F.col("node").alias("component"), F.col("component").alias("further"))
        label = materialize(moved.join(jump, "component").select("node", F.col("further").alias("component")), "labels")


def weighted_distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """edges (src, dst, weight), sources (source) -> (source, node, distance): least sums of weights, which must not be negative.

    Each round relaxes the edges of what became nearer; it ends when nothing does.
    """
    known = materialize(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("distance")).distinct(), "distances")
    nearer = known
    while not nearer.isEmpty():
        ahead = nearer.join(edges, nearer.node == edges.src).select("source", F.col("dst").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"))
        every = known.withColumn("old", F.col("distance")).unionByName(ahead.withColumn("old", F.lit(None).cast("double")))
        found = materialize(every.groupBy("source", "node").agg(F.min("distance").alias("distance"), F.min("old").alias("old")), "distances")
        nearer = found.where("old IS NULL OR distance < old").drop("old")
        known = found.drop("old")
    return known


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """(node): the nodes of the largest part in which each has ``k`` neighbours, ignoring direction, loops and parallel edges."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()
    left = materialize(both, "core-edges")
    while True:
        enough = materialize(left.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("src").alias("node")), "core-nodes")
        ends = [enough.select(F.col("node").alias(c)) for c in ("src", "dst")]
        kept = materialize(left.join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi").select("src", "dst"), "core-edges")
        if kept.count() == left.count():
            return enough
        left = kept
