"""Structured Streaming forms: deduplication, windows, emission and the stateful upsert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from riffle.functions.dates import resolve
from riffle.operators.joins import with_cache
from riffle.operators.store import Store


def file_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Parquet under path, a folder or one file, as a stream with the schema of like.

    The reader takes one file only by a pattern, so the last letter becomes a class."""
    return spark.readStream.schema(like.schema).parquet(f"{path[:-1]}[{path[-1]}]")


def with_event_time(df: DataFrame, at: str, late: str = "24 hours") -> DataFrame:
    """Event time as an instant, with a watermark: older rows are dropped by stateful operators."""
    return df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def once_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return df.dropDuplicatesWithinWatermark(keys)


def windowed(df: DataFrame, at: str, size: str, slide: str | None = None, by: tuple[str, ...] = (), value: str | None = None) -> DataFrame:
    """Counts, and sums of value, by window."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    out = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return df.groupBy(w.alias("w"), *by).agg(*out).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", *(["total"] if value else []))


def clamp_ahead(df: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """published_at of rows too far ahead is set to now."""
    return df.withColumn("published_at", resolve(F.col("published_at"), F.lit(None).cast("timestamp"), now, hours))


def cached(df: DataFrame, cache: DataFrame) -> DataFrame:
    """Stream-static left join with the model cache."""
    return with_cache(df, cache)


def upsert_into(df: DataFrame, store: Store, now: Column, checkpoint: str, **options) -> StreamingQuery:
    """Merge each micro-batch into the store. A batch that runs again gives the same rows:
    the merge is by id and the new row wins."""

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            store.save(rows, now, **options)

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(df: DataFrame, mode: str, folder: str, checkpoint: str, finish: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Run a stream over all that is there; the rows written. A repeated batch overwrites
    its own folder. In complete mode a batch replaces those before it."""
    spark = df.sparkSession

    def batch(rows: DataFrame, n: int) -> None:
        to = f"{folder}/batch=0" if mode == "complete" else f"{folder}/batch={n}"
        rows.write.mode("overwrite").parquet(to)

    q = df.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return finish(spark.read.schema(df.schema).parquet(f"{folder}/*"))
