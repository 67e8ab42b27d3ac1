"""A token index: which rows hold which words or JSON keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens_of(value: Column) -> Column:
    """Distinct tokens: the top-level keys of a JSON object, else lower-cased alphanumeric words."""
    words = F.regexp_extract_all(F.lower(value), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.coalesce(F.json_object_keys(value), words))


def build(df: DataFrame, key: str, value: str) -> DataFrame:
    """(token, key), a row per distinct token of a row."""
    return df.select(F.explode(tokens_of(F.col(value))).alias("token"), F.col(key))


def lookup(index: DataFrame, token: str) -> DataFrame:
    """Keys that hold a token."""
    return index.where(F.col("token") == token).drop("token").distinct()


def lookup_all(index: DataFrame, tokens: list[str], key: str) -> DataFrame:
    """Keys that hold every token: one pass over the postings asked for."""
    asked = sorted(set(tokens))
    return index.where(F.col("token").isin(asked)).groupBy(key).agg(F.count_distinct("token").alias("n")).where(F.col("n") == len(asked)).select(key)


def rows_holding(df: DataFrame, value: str, asked: list[str]) -> DataFrame:
    """Rows that hold every token, tested where they are: no index, and no row per token."""
    return df.where(F.size(F.array_except(F.array(*[F.lit(t) for t in sorted(set(asked))]), tokens_of(F.col(value)))) == 0)


def remove(index: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The index without some keys."""
    return index.join(keys.select(key).distinct(), key, "left_anti").select("token", key)


def counts(index: DataFrame, key: str) -> DataFrame:
    """One row: (tokens, documents) of the index."""
    return index.agg(F.count_distinct("token").alias("tokens"), F.count_distinct(key).alias("documents"))
