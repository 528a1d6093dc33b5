"""The item schema over the documents table, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-30 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def items_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: title is the first sentence, body_text the whole text."""
    n = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    i = F.col("doc_id")
    kind = F.when(n % 4 == 0, "reddit").when(n % 4 == 1, "steam").otherwise("media")
    return table(spark, sf_dir, "documents").select(
        i.alias("pos"),
        F.regexp_extract("text", "^([^.\n]*)", 1).alias("title"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/a/"), i.cast("string"), F.when(i % 5 == 0, "/?utm_source=x&p=1#top").otherwise("")).alias("url"),
        "source",
        kind.alias("source_type"),
        F.when(kind == "reddit", F.concat(F.lit("sub"), n.cast("string"))).alias("source_subreddit"),
        (now() - F.make_dt_interval(F.lit(0), F.lit(0), (i * 37 % 4320).cast("int"), F.lit(0))).alias("published_at"),
        F.col("text").alias("body_text"),
        F.col("lang").alias("language"),
        F.when(i % 11 == 0, "General").otherwise(F.concat(F.lit("g"), (i % 25).cast("string"))).alias("game"),
        (1 + F.col("n_chars") % 5).cast("int").alias("relevance"),
        F.when(i % 3 == 0, F.concat(F.lit("https://img.example.org/"), i.cast("string"))).alias("image_url"),
        F.when(n % 4 == 0, "rumor").when(F.col("n_chars") % 2 == 0, "analisis").otherwise("actualizacion").alias("category"),
    )


#: A common table expression `items` with the same rows.
ITEMS_SQL = f"""items AS (
  SELECT doc_id AS pos, regexp_extract(text, '^([^.\\n]*)', 1) AS title,
    'https://' || source || '.example.org/a/' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 5 = 0 THEN '/?utm_source=x&p=1#top' ELSE '' END AS url,
    source, CASE WHEN k % 4 = 0 THEN 'reddit' WHEN k % 4 = 1 THEN 'steam' ELSE 'media' END AS source_type,
    CASE WHEN k % 4 = 0 THEN 'sub' || CAST(k AS VARCHAR) END AS source_subreddit,
    TIMESTAMP '{NOW}' - to_minutes(CAST(doc_id * 37 % 4320 AS INT)) AS published_at,
    text AS body_text, lang AS language,
    CASE WHEN doc_id % 11 = 0 THEN 'General' ELSE 'g' || CAST(doc_id % 25 AS VARCHAR) END AS game,
    CAST(1 + n_chars % 5 AS INT) AS relevance,
    CASE WHEN doc_id % 3 = 0 THEN 'https://img.example.org/' || CAST(doc_id AS VARCHAR) END AS image_url,
    CASE WHEN k % 4 = 0 THEN 'rumor' WHEN n_chars % 2 = 0 THEN 'analisis' ELSE 'actualizacion' END AS category
  FROM (SELECT *, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS k FROM documents))"""
