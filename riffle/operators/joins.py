"""Joins: cache lookups, upserts and dimension lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riffle.functions.urls import normal_url

from .dedup import last_wins


def build_cache(*tables: DataFrame) -> DataFrame:
    """(norm_url, summary, relevance, category, game, language): of rows with a summary, that of the last table given wins, in a table the last by pos."""
    parts = [t.where(F.trim("summary") != "").select(normal_url(F.col("url")).alias("norm_url"), "summary", "relevance", "category", "game", "language", F.lit(i).alias("_table"), "pos") for i, t in enumerate(tables)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return last_wins(whole, ["norm_url"], [F.col("_table"), F.col("pos")]).drop("_table", "pos")


def with_cache(df: DataFrame, cache: DataFrame) -> DataFrame:
    """df with `hit` and the cached columns, prefixed by ai_; Spark picks the strategy by size."""
    c = cache.select("norm_url", *[F.col(x).alias(f"ai_{x}") for x in cache.columns if x != "norm_url"], F.lit(True).alias("hit"))
    keyed = df.withColumn("norm_url", normal_url(F.col("url")))
    return keyed.join(c, "norm_url", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_misses(df: DataFrame, cache: DataFrame) -> DataFrame:
    return df.withColumn("norm_url", normal_url(F.col("url"))).join(cache.select("norm_url"), "norm_url", "left_anti").select(df.columns)


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Old rows replaced by new ones of the same key, the last of which wins; a new row without
    a summary keeps the old one's unless it is blank. A blank new summary is no null."""
    new = last_wins(new, [key], [F.col("pos")])
    old = last_wins(old, [key], [F.col("pos")])
    cols = [c for c in new.columns if c != key]
    o = old.select(key, F.struct(*cols).alias("_old"))
    n = new.select(key, F.struct(*cols).alias("_new"))

    def pick(c: str) -> Column:
        fresh = F.col("_new")[c]
        if c == "summary":
            fresh = F.coalesce(fresh, F.when(F.trim(F.col("_old")[c]) != "", F.col("_old")[c]))
        return F.when(F.col("_new").isNotNull(), fresh).otherwise(F.col("_old")[c]).alias(c)

    return o.join(n, key, "full_outer").select(key, *[pick(c) for c in cols])


def lookup(df: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """Left join with a dimension whose keys are unique."""
    return df.join(dim, on, "left")


def buttons(featured: DataFrame, available: DataFrame, logos: DataFrame) -> DataFrame:
    """Featured names (name, ord) that occur or have a logo, in their order."""
    got = featured.join(available.select("name").distinct().withColumn("has", F.lit(True)), "name", "left").join(logos.select("name", "logo"), "name", "left")
    return got.where("has or logo is not null").select("name", "ord", "logo")


def restore_order(df: DataFrame) -> DataFrame:
    return df.orderBy("pos")


def featured_flag(df: DataFrame, featured: DataFrame) -> DataFrame:
    """df with `featured`: whether the trimmed, lower-case game is among featured.name."""
    f = featured.select(F.lower(F.trim("name")).alias("_f")).distinct().withColumn("featured", F.lit(True))
    return df.withColumn("_f", F.lower(F.trim("game"))).join(f, "_f", "left").drop("_f").withColumn("featured", F.coalesce("featured", F.lit(False)))


def latest_of(df: DataFrame, by: str, at: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(by).orderBy(F.desc(at), F.desc("pos"))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
