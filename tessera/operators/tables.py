"""Changes to tables as new snapshots, and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType


def insert(df: DataFrame, rows: list[tuple], columns: list[str] | None = None) -> DataFrame:
    """The table with literal rows; columns that aren't named are NULL."""
    columns = columns or df.columns
    schema = df.select(*columns).schema
    return insert_select(df, df.sparkSession.createDataFrame(rows, schema), columns)


def insert_select(df: DataFrame, rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The table with the rows of a query, matched by position and cast to the table's types."""
    return df.unionByName(shaped(df, rows, columns))


def shaped(df: DataFrame, rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of a query as the table's, by position; text for an array column is read as JSON, so '[1,2]' is a vector."""
    columns = columns or df.columns
    known = {c.lower(): c for c in df.columns}
    if len(rows.columns) != len(columns) or any(c.lower() not in known for c in columns):
        raise ValueError(f"{len(rows.columns)} values for the columns {', '.join(columns)}")
    named = rows.toDF(*[known[c.lower()] for c in columns])
    own = dict(named.dtypes)

    def value(c: str) -> Column:
        kind = df.schema[c].dataType
        if own.get(c) == "string" and isinstance(kind, ArrayType):
            return F.from_json(F.col(f"`{c}`"), kind)
        return (F.col(f"`{c}`") if c in own else F.lit(None)).cast(kind)

    return named.select(*[value(c).alias(c) for c in df.columns])


def update(df: DataFrame, sets: dict[str, Column], where: Column | None = None) -> DataFrame:
    """The table with columns set where the condition holds; expressions see the old values."""
    cond = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return df.select(*[F.when(cond, sets[c].cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in df.columns])


def delete(df: DataFrame, where: Column | None = None) -> DataFrame:
    """The table without the rows where the condition holds; an unknown condition keeps the row."""
    return df.where(F.lit(False)) if where is None else df.where(~F.coalesce(where, F.lit(False)))


def analyze(df: DataFrame, exact: bool = True) -> DataFrame:
    """(column_name, n_rows, n_null, n_distinct, least, greatest).

    Exact distinct counts shuffle every column's values; without ``exact`` sketches count
    them in one pass.
    """
    distinct = F.count_distinct if exact else F.approx_count_distinct
    aggs = [F.count("*").alias("n")]
    for c in df.columns:
        aggs += [F.count(F.col(c)).alias(f"{c}__set"), distinct(F.col(c)).alias(f"{c}__ndv"), F.min(c).cast("string").alias(f"{c}__min"), F.max(c).cast("string").alias(f"{c}__max")]
    one = df.agg(*aggs)
    each = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col("n").alias("n_rows"),
                (F.col("n") - F.col(f"{c}__set")).alias("n_null"),
                F.col(f"{c}__ndv").alias("n_distinct"),
                F.col(f"{c}__min").alias("least"),
                F.col(f"{c}__max").alias("greatest"),
            )
            for c in df.columns
        ]
    )
    return one.select(F.inline(each))


def analyze_full(df: DataFrame, common: int = 10, buckets: int = 50) -> DataFrame:
    """``analyze`` with most_common (array of value and n, as text) and bounds (equi-depth over the distinct values, as text).

    One pass counts the values of all columns, a row each; the report is made of those.
    """
    every = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns])
    counted = df.select(F.inline(every)).where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))
    # The rank is filtered by a limit, which Spark applies before the exchange too.
    top = counted.withColumn("nth", rank).where(F.col("nth") <= common).groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct("nth", "value", "n"))).alias("top"))
    top = top.select("column_name", F.transform("top", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias("most_common"))
    numeric = [f.name for f in df.schema if isinstance(f.dataType, NumericType)]
    cuts = [i / buckets for i in range(buckets + 1)]
    bounds = None
    if numeric:
        distinct = counted.where(F.col("column_name").isin(numeric)).groupBy("column_name")
        bounds = distinct.agg(F.percentile_approx(F.col("value").cast("double"), cuts, 10_000).cast("array<string>").alias("bounds"))
    sizes = counted.groupBy("column_name").agg(F.count("*").alias("values"))
    found = analyze(df, exact=False).join(sizes, "column_name", "left").withColumn("n_distinct", F.coalesce("values", F.lit(0).cast("bigint"))).drop("values")
    found = found.join(top, "column_name", "left")
    return found.join(bounds, "column_name", "left") if bounds is not None else found.withColumn("bounds", F.lit(None).cast("array<string>"))


def most_common(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """(value, n): the k most frequent values."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def histogram(df: DataFrame, column: str, buckets: int = 50) -> DataFrame:
    """(bounds): equi-depth bounds over the distinct values."""
    cuts = [i / buckets for i in range(buckets + 1)]
    return df.select(column).distinct().agg(F.percentile_approx(column, cuts, 10_000).alias("bounds"))
