"""One registry feeds the driver's queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` is the same result as SQL over the same tables."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


#: Rows of a table that a task joins in a query of many pairs, and rows up to which the other table goes to all tasks.
PAIRED_ROWS, SENT_ROWS = 1 << 16, 1_000_000


def sql_query(name: str, text: str, tables: tuple[str, ...], oracle: str | None = None, pairs: tuple[str, str] | None = None) -> None:
    """Register a query that is one SQL text; ``oracle`` only where the dialects differ.

    ``pairs`` names two tables (or one twice) whose join meets far more pairs than either has
    rows, so that files say little about the work: the text runs over the first dealt
    evenly over tasks, a bounded number of rows each, and the second sent to all if it is small.
    """
    from tessera.session import register_views

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_views(spark, sf_dir, tables)
        if pairs is None:
            return spark.sql(text)
        dealt, sent = pairs
        few = spark.table(sent).count() <= SENT_ROWS
        tasks = max(2 * spark.sparkContext.defaultParallelism, -(-spark.table(dealt).count() // PAIRED_ROWS))
        spark.table(dealt).repartition(tasks).createOrReplaceTempView(dealt)
        if few:
            F.broadcast(spark.table(sent)).createOrReplaceTempView(sent)
        found = spark.sql(text)
        register_views(spark, sf_dir, tables)
        return found

    run.__doc__ = f"{name}: a SQL text over {', '.join(tables) or 'no table'}."
    query(name, oracle or text)(run)
