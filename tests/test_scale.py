"""Steps whose cost must not outgrow their input: plans, and results where pieces of the work meet."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import tessera.plans.catalogue  # noqa: F401
from tessera import scratch
from tessera.functions.vectors import l2
from tessera.operators import graph, nearest, relational, vectors
from tessera.registry import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_salted_copies_are_not_broadcast(spark):
    a, b = spark.range(100).selectExpr("id % 3 AS k"), spark.range(3).selectExpr("id AS k", "id AS v")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert "Broadcast" not in plan(relational.salted_join(a, b, "k", 4, how))


def answers(df) -> list[tuple]:
    return sorted((r["query"], r["rank"], r.id, repr(r.distance)) for r in df.collect())


def test_neighbours_in_matrices_are_those_of_all_pairs(spark, monkeypatch):
    """Copies, ties, odd values and rows without a vector, in pieces of a few rows."""
    monkeypatch.setattr(nearest, "ROWS", 16)
    monkeypatch.setattr(nearest, "QUERIES", 4)
    rng = np.random.default_rng(3)
    vs = [[float(x) for x in rng.normal(size=3)] for _ in range(60)]
    vs += [[0.1, 0.2, 0.3]] * 40 + [[float(x) for x in v] for v in rng.integers(0, 3, (60, 3))] + [None, [1.0, None, 2.0], [float("nan"), 0.0, 1.0], [float("inf"), 0.0, 0.0], [1e200, 0.0, 0.0], [1e-200, 0.0, 0.0]] * 3
    few = [None, [float("nan"), 0.0, 1.0], None, [1.0, 2.0, 3.0]]
    for points, k in ((vs, 5), (few, 3), (few, 9), ([None] * 7, 2)):
        df = spark.createDataFrame([(f"k{i * 37 % 1000:04d}", v) for i, v in enumerate(points)], "id string, v array<double>")
        q = df.where("crc32(id) % 3 = 0 OR v IS NULL")
        far = df.join(q.select(F.col("id").alias("query"), F.col("v").alias("__q"))).select("query", "id", l2(F.col("v"), F.col("__q")).alias("distance"))
        order = Window.partitionBy("query").orderBy(F.col("distance").asc_nulls_last(), "id")
        want = answers(far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        assert answers(vectors.knn_batch(df, q, "v", "id", k)) == want
        assert one_task(df, q, k) == [(a, i, d) for a, _, i, d in want]
        if k == 5:
            assert answers(vectors.knn_batch(df, q, "v", "id", k, block=7)) == want


def one_task(df, q, k) -> list[tuple]:
    """What one task finds, called here so that its pieces are small; rows of two lists."""
    rows, q = df.orderBy("id").toArrow(), q.toArrow()
    n = rows.num_rows
    rows = pa.table({"id": rows["id"], "v": rows["v"], "list": pa.array([i % 2 for i in range(n)]), "at": pa.array(range(n))}).sort_by([("list", "ascending"), ("at", "ascending")])
    out = pa.Table.from_batches(nearest.nearest_rows(rows.combine_chunks().to_batches(), pa.table({"query": q["id"], "vector": q["v"], "lists": pa.array([[0, 1]] * q.num_rows)}), k))
    key = lambda r: (r["query"], r["distance"] is None, math.isnan(r["distance"] or 0.0), r["distance"] or 0.0, r["id"])
    return [(r["query"], r["id"], repr(r["distance"])) for r in sorted(out.to_pylist(), key=key)]


def test_a_single_file_of_vectors_is_dealt_over_tasks(spark):
    points = spark.range(400).selectExpr("id", "array(cast(id as double), 1D) AS v").coalesce(1)
    found = vectors.knn_batch(points, points.where("id % 50 = 0"), "v", "id", 3)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found) and "RoundRobinPartitioning" in plan(found)
    with pytest.raises(Exception, match="different dimensions"):
        vectors.knn_batch(points, points.selectExpr("id", "array(1D) AS v"), "v", "id", 3).collect()


def test_lists_of_one_file_are_written_by_many_tasks(spark):
    points = spark.range(4000).selectExpr("id", "array(cast(id % 97 as double), cast(id % 89 as double)) AS v").coalesce(1)
    index = vectors.build_ivf(points, "v", "id", lists=2)
    sizes = [r["n"] for r in index.rows.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2000
    assert index.search_batch(points.where("id % 500 = 0"), 5, 2).drop("distance").count() == 40


@pytest.mark.parametrize("size", [1 << 20, 40, 3])
def test_components_over_pieces(spark, monkeypatch, size):
    """Chains, stars and loops whose edges come in any order, in pieces that cut them."""
    monkeypatch.setattr(graph, "PIECE_EDGES", size)
    pairs = [(i, i + 1) for i in range(0, 200) if i % 40 != 39] + [(1000, 1000 + i) for i in range(1, 30)] + [(7000, 7000), (500, 2), (2, 500)]
    pairs = [pairs[i * 101 % len(pairs)] for i in range(len(pairs))]
    df = spark.createDataFrame(pairs, "src bigint, dst bigint").repartition(3)
    least = {x: x for p in pairs for x in p}
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    assert {r.node: r.component for r in graph.weakly_connected(df).collect()} == least


def test_components_of_whole_pieces_take_no_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "materialize", lambda df, name: written.append(name) or scratch.materialize(df, name))
    chains = spark.range(3000, numPartitions=1).where("id % 30 <> 29").selectExpr("id AS src", "id + 1 AS dst")
    assert graph.weakly_connected(chains).groupBy("component").count().where("count = 30").count() == 100
    assert len(written) <= 4


@pytest.mark.parametrize("size", [1 << 20, 12, 1])
def test_ranks_over_pieces(spark, monkeypatch, size):
    """Components that fit in a piece and others, with loops, parallel edges and dead ends."""
    monkeypatch.setattr(graph, "PIECE_EDGES", size)
    pairs = [(i, i + 1) for i in range(0, 60) if i % 6 != 5] + [(100, 100 + i % 9) for i in range(30)] + [(103, 104), (104, 100), (7000, 7000), (3, 1), (3, 1)]
    pairs = [pairs[i * 37 % len(pairs)] for i in range(len(pairs))]
    nodes = sorted({x for p in pairs for x in p})
    out = {x: sum(a == x for a, _ in pairs) for x in nodes}
    want = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(20):
        new = dict.fromkeys(nodes, 0.15 / len(nodes))
        for a, b in pairs:
            new[b] += 0.85 * want[a] / out[a]
        want = new
    got = [tuple(r) for r in graph.pagerank(spark.createDataFrame(pairs, "src bigint, dst bigint").repartition(3)).collect()]
    assert len(got) == len(nodes) and all(abs(want[x] - r) < 1e-13 for x, r in got)


def test_ranks_of_small_components_take_no_rounds(spark):
    chains = spark.range(3000).where("id % 30 <> 29").selectExpr("id AS src", "id + 1 AS dst")
    assert "Join" not in plan(graph.pagerank(chains))


@pytest.mark.parametrize("name", ["join_compound_on", "join_self"])
def test_joins_of_many_pairs_are_dealt_over_tasks(spark, sf_dir, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = QUERIES[name](spark, sf_dir)
        assert "BroadcastHashJoin" in plan(found)
        assert found.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
        # The views left behind are the tables as they are.
        assert "RoundRobin" not in plan(spark.table("supplier"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
