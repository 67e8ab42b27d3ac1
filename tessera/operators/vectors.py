"""Nearest neighbours: exact, batched, and approximate by inverted lists."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.functions.vectors import l2
from tessera.operators.nearest import nearest_rows
from tessera.scratch import materialize
from tessera.session import share_package

#: Rows that centroids are fitted on; every row is listed.
FIT_ROWS = 20_000
#: Queries that are broadcast at once.
QUERY_BLOCK = 4_096


def knn(df: DataFrame, vector: str, query: list[float], k: int, key: str, where: Column | None = None) -> DataFrame:
    """The k rows nearest to one vector, with ``distance``; ties by key.  A filter applies before."""
    rows = df if where is None else df.where(where)
    near = rows.withColumn("distance", l2(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))
    return near.orderBy(F.col("distance").asc_nulls_last(), key).limit(k)


def knn_batch(df: DataFrame, queries: DataFrame, vector: str, key: str, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query, key, distance, rank) for a stated set of queries against all rows.

    Queries are counted and go out in blocks of a bounded number, each broadcast.  A task
    keeps the k best of its rows for a query before the shuffle, so what is exchanged
    follows the queries, not the rows.  Every query meets every row, as matrices.
    """
    return _meet(df.select(F.col(key), F.col(vector), F.lit(0)), queries.select(F.col(key), F.col(vector), F.array(F.lit(0))), key, k, block)


def _tasks(spark: SparkSession) -> int:
    """Parts that work over rows of few files is dealt to."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _meet(rows: DataFrame, queries: DataFrame, key: str, k: int, block: int) -> DataFrame:
    """rows (key, vector, list), queries (key, vector, lists) -> the k nearest rows of a query's lists.

    Rows are dealt evenly over the tasks, however few files they come in, and each block of
    queries is a pass over them.
    """
    spark = rows.sparkSession
    share_package(spark)
    blocks = max(1, -(-queries.count() // block))
    tasks = _tasks(spark)
    queries = queries.toDF("query", "vector", "lists").withColumn("vector", F.col("vector").cast("array<double>"))
    rows = rows.toDF(key, "__v", "__list").withColumn("__v", F.col("__v").cast("array<double>")).repartition(tasks)
    if blocks > 1:
        queries = materialize(queries.withColumn("__block", F.pmod(F.xxhash64("query"), F.lit(blocks))), "queries")
        rows = materialize(rows, "rows")
    # The number of a row follows the key within a task, and rows come by list.
    rows = rows.sortWithinPartitions(key).withColumn("__at", F.monotonically_increasing_id()).sortWithinPartitions("__list", "__at")
    schema = StructType([StructField("query", queries.schema["query"].dataType), StructField(key, rows.schema[key].dataType), StructField("distance", DoubleType())])
    parts = []
    for i in range(blocks):
        asked = (queries.where(F.col("__block") == i).drop("__block") if blocks > 1 else queries).toArrow()
        shared = spark.sparkContext.broadcast(asked)
        parts.append(rows.mapInArrow(lambda batches, shared=shared: nearest_rows(batches, shared.value, k), schema))
    order = Window.partitionBy("query").orderBy(F.col("distance").asc_nulls_last(), key)
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass
class InvertedLists:
    """Vectors by their nearest centroid."""

    centroids: np.ndarray
    rows: DataFrame
    vector: str
    key: str

    def nearest_lists(self, query: list[float], probes: int) -> list[int]:
        """The lists whose centroids are nearest; the only list if there are none."""
        if not len(self.centroids):
            return [0]
        far = ((self.centroids - np.asarray(query, float)) ** 2).sum(axis=1)
        return np.argsort(far, kind="stable")[:probes].tolist()

    def pruned(self, query: list[float], probes: int) -> DataFrame:
        """The rows of those lists."""
        return self.rows.where(F.col("__list").isin(self.nearest_lists(query, probes))).drop("__list")

    def search(self, query: list[float], k: int, probes: int) -> DataFrame:
        """The k nearest rows of the lists whose centroids are nearest."""
        return knn(self.pruned(query, probes), self.vector, query, k, self.key)

    def added(self, rows: DataFrame) -> InvertedLists:
        """The lists with more rows, under the centroids there are."""
        return InvertedLists(self.centroids, self.rows.unionByName(_listed(rows, self.vector, self.key, self.centroids)), self.vector, self.key)

    def search_batch(self, queries: DataFrame, k: int, probes: int, block: int = QUERY_BLOCK) -> DataFrame:
        """(query, key, distance, rank) for a stated set of queries, each by its own lists; blocks as in ``knn_batch``."""
        far = _distances(F.col(self.vector), self.centroids)
        asked = queries.select(F.col(self.key), F.col(self.vector), F.slice(F.array_sort(far)["i"], 1, probes))
        return _meet(self.rows.select(F.col(self.key), F.col(self.vector), F.col("__list")), asked, self.key, k, block)


def _distances(vector: Column, centroids: np.ndarray) -> Column:
    """(d, i) for each centroid; they are one constant, whatever their number."""
    if not len(centroids):
        return F.array(F.struct(F.lit(0.0).alias("d"), F.lit(0).alias("i")))
    every = F.from_json(F.lit(json.dumps(centroids.tolist())), "array<array<double>>")
    return F.transform(every, lambda c, i: F.struct(l2(vector, c).alias("d"), i.alias("i")))


def _listed(df: DataFrame, vector: str, key: str, centroids: np.ndarray) -> DataFrame:
    """Rows with ``__list``, the number of the nearest centroid (ties to the first, 0 without a vector), written by list.

    Rows are dealt evenly over the tasks before, and a list over several files, since lists may be few or uneven.
    """
    tasks = _tasks(df.sparkSession)
    nearest = F.coalesce(F.when(F.col(vector).isNotNull(), F.array_min(_distances(F.col(vector), centroids))["i"]), F.lit(0))
    part = F.pmod(F.xxhash64(key), F.lit(-(-tasks // max(1, len(centroids)))))
    return materialize(df.repartition(tasks).withColumn("__list", nearest).repartition(tasks, "__list", part).sortWithinPartitions("__list"), "ivf")


def build_ivf(df: DataFrame, vector: str, key: str, lists: int = 16, fit_rows: int = FIT_ROWS, seed: int = 1) -> InvertedLists:
    """Centroids by k-means on a bounded sample (Lloyd, on the driver), then every row listed and written by list.

    An empty table has no centroids and one list.
    """
    picked = df.where(F.col(vector).isNotNull()).select(F.col(key), F.col(vector)).orderBy(F.xxhash64(key), key).limit(fit_rows).collect()
    points = np.array([r[1] for r in picked], float)
    centres = points
    if len(points):
        rng = np.random.default_rng(seed)
        centres = points[rng.choice(len(points), min(lists, len(points)), replace=False)]
        for _ in range(15):
            squares = (centres**2).sum(axis=1)
            owner = np.concatenate([(squares - 2 * points[a : a + 4096] @ centres.T).argmin(axis=1) for a in range(0, len(points), 4096)])
            centres = np.array([points[owner == i].mean(axis=0) if (owner == i).any() else c for i, c in enumerate(centres)])
    return InvertedLists(centres, _listed(df, vector, key, centres), vector, key)
