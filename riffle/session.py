"""Session settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def builder(app: str = "riffle") -> SparkSession.Builder:
    """A builder with SETTINGS; the caller adds master, memory and shuffle partitions."""
    return SparkSession.builder.appName(app).config(map=SETTINGS)
