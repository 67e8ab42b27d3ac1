"""Readers and sinks.  Paths are opened by Spark only, so any store that it knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "csv", "json", "text")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A table from files.  CSV needs a schema unless ``inferSchema`` is asked for."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    reader = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {}) | options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists", **options: str) -> None:
    """A table to files."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    out = df.write.format(kind).mode(mode).options(**({"header": "true"} if kind == "csv" else {}) | options)
    (out.partitionBy(*partition_by) if partition_by else out).save(path)


def save_bucketed(df: DataFrame, name: str, by: str, buckets: int) -> None:
    """A managed table bucketed and sorted by a key, so that joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, by).sortBy(by).saveAsTable(name)
