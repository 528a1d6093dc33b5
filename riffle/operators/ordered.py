"""A global order of rows without one task: range partitions, and prefix sums of their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Bits of monotonically_increasing_id that count within a partition.
_WITHIN = 33


def numbered(df: DataFrame, order: list[Column], name: str = "n", first: int = 0) -> DataFrame:
    """df with `name`: the place of each row in the order, from `first` on, without gaps; rows
    equal in the order have distinct places. The rows are dealt out by ranges of the order and
    written once; the driver sees one count for each range."""
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", _WITHIN)
    ranges, upto = [], first
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        ranges.append((r["part"], upto))
        upto += r["count"]
    before = df.sparkSession.createDataFrame(ranges, "_part long, _before long")
    joined = placed.withColumn("_part", part).join(F.broadcast(before), "_part")  # as many rows as partitions
    return joined.select(*df.columns, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _WITHIN) - 1))).alias(name))
