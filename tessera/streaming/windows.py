"""Windowed aggregates over event streams; the same functions take batch and streaming frames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.scratch import scratch_root


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """A stream of the event files in a folder."""
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def timed(events: DataFrame, late: str | None = None) -> DataFrame:
    """Events with a zoned time, and a watermark if lateness is given."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows if late is None else rows.withWatermark("ts", late)


def windowed_counts(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) per tumbling or sliding window."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(user_id, start, n) per session of a user."""
    out = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame) -> DataFrame:
    """Each event once, within the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now and read the result, a table in the shared folder.

    A batch that runs again writes its part anew; in complete mode each batch replaces the last.
    """
    spark = stream.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/result/{number if mode == 'append' else 0:09d}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}/result")
