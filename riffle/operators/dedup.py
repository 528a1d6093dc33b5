"""Unions, set operations and deduplication by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last by order. max_by combines before it shuffles, as no window does."""
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.max_by(row, rank).alias("_row")).select("_row.*")


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def minus(df: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose key is not in kept."""
    return df.join(kept.select(*keys).distinct(), keys, "left_anti")


def exact_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(hash, first key, n) for each distinct text; texts go by their SHA-256."""
    return df.groupBy(F.sha2(F.col(text), 256).alias("hash")).agg(F.min(key).alias(key), F.count("*").alias("n"))
