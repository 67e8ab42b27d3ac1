"""Shards by extendible hashing.

A directory maps hash prefixes to buckets.  It starts with the empty prefix, and only a
bucket over its byte limit splits on one more bit, so prefixes are as long as their
bucket needs.  Bucket sizes come from a histogram over prefixes a few bits longer than
the even depth; it is rolled up to every shorter prefix in one aggregation, and a
bucket of the directory is a prefix that fits while its parent does not.  Cells of the
histogram that still don't fit are refined by another round over their rows alone.

The first 128 bits are the MD5 of the key.  Equal keys share them; what follows is the
MD5 of the row's number in the written table, so that copies of one key split too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.names import fresh, own
from tessera.scratch import materialize

SHARD_BYTES = 1 << 20
#: Bits of the histogram beyond the depth that even buckets would need.
SPARE_BITS = 3
#: All bits of a row.
MOST_BITS = 256


def _bits(digest: Column) -> Column:
    """The 128 bits of an MD5 in hex, as a string of 0 and 1."""
    half = [F.lpad(F.conv(F.substring(digest, at, 16), 16, 2), 64, "0") for at in (1, 17)]
    return F.concat(*half)


def sized_rows(docs: DataFrame, key: Column, size: Column) -> DataFrame:
    """The rows with ``__row`` (a number that stays), ``__key`` (MD5 of the key) and ``__bytes``, written once."""
    named = docs.withColumn("__row", F.monotonically_increasing_id())
    named = named.withColumn("__key", F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")))
    return materialize(named.withColumn("__bytes", F.coalesce(size, F.lit(0)).cast("bigint")), "sized-rows")


def assign(rows: DataFrame, limit: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Of sized rows: (row, shard), and the directory (shard, depth, n_docs, n_bytes, oversized)."""
    row_bits = F.concat(_bits(F.col("__key")), _bits(F.md5(F.col("__row").cast("string").cast("binary"))))
    left = rows.select("__row", "__key", "__bytes")
    depth, assigned, directory = 0, [], []
    while True:
        total, count = left.agg(F.sum("__bytes"), F.count("*")).first()
        if not count:
            break
        open_buckets = max(1, left.select(F.substring(row_bits, 1, depth)).distinct().count()) if depth else 1
        more = min(MOST_BITS - depth, SPARE_BITS + max(0, math.ceil(math.log2(max(1.0, total / limit / open_buckets)))))
        deep = depth + more
        own = left.withColumn("cell", F.substring(row_bits, 1, deep))
        cells = materialize(own.groupBy("cell").agg(F.sum("__bytes").alias("n_bytes"), F.count("*").alias("n_docs")), "cells")
        levels = cells.withColumn("d", F.explode(F.sequence(F.lit(depth), F.lit(deep)))).withColumn("prefix", F.expr("substring(cell, 1, d)"))
        buckets = materialize(levels.groupBy("prefix", "d").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_docs").alias("n_docs")), "buckets")
        last = F.col("d") == MOST_BITS
        fits = (F.col("n_bytes") <= limit) | (F.col("n_docs") == 1)
        parents = buckets.where(~fits).select(F.col("prefix").alias("above"))
        # A bucket of the directory: it fits, or no bit is left; its parent doesn't fit.
        leaves = buckets.where(fits | last)
        if depth == 0:
            top = leaves.where("d = 0")
            leaves = top.unionByName(leaves.where("d > 0").join(parents, F.expr("substring(prefix, 1, d - 1) = above"), "left_semi"))
        else:
            leaves = leaves.join(parents, F.expr("substring(prefix, 1, d - 1) = above"), "left_semi")
        leaves = materialize(leaves.withColumn("oversized", F.col("n_bytes") > limit), "leaves")
        directory.append(leaves)
        placed = materialize(levels.select("cell", "prefix").join(leaves.select("prefix"), "prefix").select("cell", F.col("prefix").alias("shard")), "placed")
        joined = materialize(own.join(placed, "cell", "left"), "assigned")
        assigned.append(joined.where("shard is not null").select("__row", "shard"))
        left, depth = joined.where("shard is null").select("__row", "__key", "__bytes"), deep
        if depth >= MOST_BITS:
            break
    if not assigned:
        empty = rows.sparkSession.createDataFrame([], "__row bigint, shard string")
        return empty, rows.sparkSession.createDataFrame([], "shard string, depth int, n_docs bigint, n_bytes bigint, oversized boolean")
    found, table = assigned[0], directory[0]
    for x, y in zip(assigned[1:], directory[1:]):
        found, table = found.unionByName(x), table.unionByName(y)
    return found, table.select(F.col("prefix").alias("shard"), F.col("d").alias("depth"), "n_docs", "n_bytes", "oversized")


def shard_documents(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes): a row per document.

    shard: the hash prefix as bits, empty if one shard holds all; n_bytes: UTF-8 bytes
    of the text, 0 for null.  Shards hold ``limit`` bytes at most, but for a document
    that is larger alone, which has a shard of its own.  Rows without a doc_id share the
    key of the empty string.  Repeated rows are kept and may lie in different shards.
    """
    rows = sized_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.octet_length(F.col("text").cast("string")).alias("__size")), F.col("doc_id"), F.col("__size"))
    found, directory = assign(rows, limit)
    named = found.join(directory.select("shard", "depth", F.col("n_bytes").alias("shard_bytes")), "shard")
    return rows.join(named, "__row").select("doc_id", F.col("__bytes").alias("n_bytes"), "shard", "depth", "shard_bytes")


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> DataFrame:
    """Write the documents as one Parquet folder per shard, named by a new column; returns the directory.

    The column is ``shard``, with underscores in front where the documents have one; its
    values are ``b`` and the prefix.  All rows and columns stay; nulls and repeats are as
    in ``shard_documents``, and an empty table writes no shard.
    """
    rows = sized_rows(docs, F.col("doc_id"), F.octet_length(F.col("text").cast("string")))
    found, directory = assign(rows, limit)
    name = fresh(docs.columns, "shard")
    placed = found.select("__row", F.concat(F.lit("b"), F.col("shard")).alias(name))
    joined = rows.join(placed, "__row").select(*own(docs), name)
    joined.repartition(name).write.partitionBy(name).parquet(path)
    return directory
