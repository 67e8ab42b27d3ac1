"""Small cases with known results."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import json as j
from tessera.functions import scalar, vectors
from tessera.operators import graph, relational, tables, tokens
from tessera.operators import vectors as nearest
from tessera.sources import files
from tessera.sources.catalog import CATALOG_VIEWS, catalog_view


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def test_joins(spark):
    users = spark.createDataFrame([(1, "Ann"), (2, "Bob"), (3, "Carol")], "id int, name string")
    orders = spark.createDataFrame([(1, 1, 10), (2, 2, 20), (3, 1, 30)], "oid int, id int, total int")
    assert users.join(orders, "id").count() == 3
    left = users.join(orders, "id", "left")
    assert [r.total for r in left.where("name = 'Carol'").collect()] == [None]


def test_window_ranks(spark):
    scores = spark.createDataFrame([("a", 100), ("b", 100), ("c", 90)], "player string, score int")
    ranked = scores.withColumn("r", F.rank().over(Window.orderBy(F.desc("score")))).orderBy("r", "player").collect()
    assert [r.r for r in ranked] == [1, 1, 3]


def test_shortest_path(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4)])
    got = {(r.source, r.target): r.hops for r in graph.shortest_paths(e, spark.createDataFrame([(1, 4), (4, 1), (2, 2)], "source bigint, target bigint")).collect()}
    assert got == {(1, 4): 3, (4, 1): None, (2, 2): 0}


def test_pagerank_against_numpy(spark):
    pairs = [(1, 2), (1, 3), (2, 3), (3, 1), (3, 1), (4, 5)]
    got = {r.node: r["rank"] for r in graph.pagerank(edges(spark, pairs)).collect()}
    nodes = [1, 2, 3, 4, 5]
    rank = np.full(5, 0.2)
    for _ in range(20):
        new = np.full(5, 0.15 / 5)
        for a, b in pairs:
            new[b - 1] += 0.85 * rank[a - 1] / sum(1 for x, _ in pairs if x == a)
        rank = new
    assert all(abs(got[n] - rank[n - 1]) < 1e-12 for n in nodes)
    assert graph.pagerank(edges(spark, [])).count() == 0


def test_recursion_stops_on_cycles(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])
    got = {r.node: r.depth for r in graph.k_hop(e, spark.createDataFrame([(1,)], "node bigint")).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3}


def test_components(spark):
    got = {r.node: r.component for r in graph.weakly_connected(edges(spark, [(5, 4), (4, 9), (1, 2), (7, 7)])).collect()}
    assert got == {4: 4, 5: 4, 9: 4, 1: 1, 2: 1, 7: 7}


def test_vectors(spark):
    a, b = vectors.parse(F.lit("[0,0]")), vectors.parse(F.lit("[3,4]"))
    assert spark.range(1).select(vectors.l2(a, b)).first()[0] == 5.0
    with pytest.raises(Exception, match="dimensions"):
        spark.range(1).select(vectors.l2(a, vectors.parse(F.lit("[1]")))).collect()


def test_json_containment_by_column(spark):
    cases = [('{"a":1,"b":[1,2]}', '{"b":[2]}', True), ('[1,2]', "2", True), ('{"a":1}', '{"a":true}', False), ("no", "1", False), (None, "1", None)]
    rows = spark.createDataFrame([(x, y) for x, y, _ in cases], "x string, y string")
    got = [r[0] for r in rows.select(j.contains_column(F.col("x"), F.col("y"))).collect()]
    assert got == [w for *_, w in cases]
    for x, y, want in cases:
        assert spark.createDataFrame([(x,)], "x string").select(j.contains(F.col("x"), y)).first()[0] == want


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.byte_length(F.lit("é")), scalar.quote_literal(F.lit("a'b")), scalar.session_constant("version"), scalar.session_constant("pg_get_expr")
    ).first()
    assert row[0] == 2 and row[1] == "'a''b'" and row[2].startswith("PostgreSQL") and row[3] is None


def test_table_changes(spark):
    t = spark.createDataFrame([(1, 20), (2, None), (3, 30)], "id int, age int")
    assert {(r.id, r.age) for r in tables.update(t, {"age": F.col("age") + 1}, F.col("id") == 3).collect()} == {(1, 20), (2, None), (3, 31)}
    assert {r.id for r in tables.delete(t, F.col("age") > 25).collect()} == {1, 2}
    assert tables.delete(t).count() == 0
    assert tables.insert(t, [(9,)], ["id"]).where("id = 9").first().age is None
    stats = {r.column_name: r for r in tables.analyze(t).collect()}
    assert stats["age"].n_null == 1 and stats["age"].n_distinct == 2


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "The cat, the dog"), (2, '{"cat": 1}'), (3, None)], "id int, text string")
    index = tokens.build(docs, "id", "text")
    assert {r.id for r in tokens.lookup(index, "cat").collect()} == {1, 2}
    assert {r.id for r in tokens.lookup_all(index, ["the", "dog"], "id").collect()} == {1}


def test_asof_join(spark, monkeypatch):
    a = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    b = spark.createDataFrame([(1, 2, "x"), (1, 5, "y")], "k int, t int, v string")
    got = {(r.k, r.t): r.right_v for r in relational.asof_join(a, b, "k", "t", ["v"]).collect()}
    assert got == {(1, 5): "y", (1, 1): None, (2, 9): None}
    for width in (1.0, 3.0, 100.0):
        assert got == {(r.k, r.t): r.right_v for r in relational.asof_join(a, b, "k", "t", ["v"], width).collect()}
    for rows in (1, 2):
        monkeypatch.setattr(relational, "ASOF_ROWS", rows)
        assert got == {(r.k, r.t): r.right_v for r in relational.asof_join(a, b, "k", "t", ["v"]).collect()}
    assert relational.asof_join(a.limit(0), b, "k", "t", ["v"]).count() == 0


def test_knn_in_blocks(spark):
    points = spark.createDataFrame([(i, [float(i % 7), float(i // 7)]) for i in range(40)], "id int, v array<double>")
    queries = points.where("id % 5 = 0")
    whole, parts = (nearest.knn_batch(points, queries, "v", "id", 3, block=n).select("query", "id", "rank").collect() for n in (100, 3))
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts)) and len(whole) == 24


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    for kind in ("parquet", "orc", "csv", "json"):
        files.write(df, f"{tmp_path}/{kind}", kind)
        assert {tuple(r) for r in files.read(spark, f"{tmp_path}/{kind}", kind, df.schema).collect()} == {(1, "a"), (2, "b")}
    with pytest.raises(ValueError):
        files.read(spark, "x", "dbf")


def test_catalog_views(spark):
    spark.createDataFrame([(1, 2.0)], "a bigint, b double").createOrReplaceTempView("seen_here")
    for name in CATALOG_VIEWS:
        assert catalog_view(spark, name).columns
    found = catalog_view(spark, "information_schema.columns").where("table_name = 'seen_here'").orderBy("ordinal_position").collect()
    assert [(r.column_name, r.data_type) for r in found] == [("a", "bigint"), ("b", "double precision")]


def test_salted_joins(spark):
    a, b = spark.createDataFrame([(1,)] * 5 + [(3,)], "k int"), spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(map(str, relational.salted_join(a, b, "k", 4, how).collect())) == sorted(map(str, a.join(b, "k", how).collect()))
    with pytest.raises(ValueError):
        relational.salted_join(a, b, "k", how="right")


def test_range_join_of_long_spans(spark):
    points = spark.createDataFrame([(float(x),) for x in range(0, 5000, 7)], "p double")
    spans = spark.createDataFrame([(1, 0.0, 4999.0), (2, 3.0, 3.5), (3, 10.0, 10.0), (4, 70.0, 1000.0), (5, None, 4.0), (6, 7.0, 64.0 * 64.0)], "s int, low double, high double")
    want = sorted((r.s, r.p) for r in points.join(spans, (F.col("p") >= F.col("low")) & (F.col("p") < F.col("high"))).collect())
    assert sorted((r.s, r.p) for r in relational.range_join(points, spans, "p", "low", "high", 1.0).collect()) == want
    assert relational.range_join(points, spans.limit(0), "p", "low", "high", 1.0).count() == 0


def test_weighted_distances_and_cores(spark):
    e = spark.createDataFrame([(1, 2, 5.0), (1, 3, 1.0), (3, 2, 1.5), (2, 4, 1.0), (4, 1, 0.0)], "src bigint, dst bigint, weight double")
    got = {r.node: r.distance for r in graph.weighted_distances(e, spark.createDataFrame([(1,)], "source bigint")).collect()}
    assert got == {1: 0.0, 3: 1.0, 2: 2.5, 4: 3.5}
    links = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 5), (2, 1)])
    assert {r.node for r in graph.k_core(links, 2).collect()} == {1, 2, 3}
    assert graph.k_core(links, 3).count() == 0


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    spark.sql(f"CREATE DATABASE bucketed LOCATION '{tmp_path}'")
    try:
        for name, n in (("one", 500), ("two", 300)):
            files.save_bucketed(spark.range(n).selectExpr("id AS k", f"id * 2 AS {name}"), f"bucketed.{name}", "k", 4)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        met = spark.table("bucketed.one").join(spark.table("bucketed.two"), "k")
        assert met.count() == 300
        assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE bucketed CASCADE")
