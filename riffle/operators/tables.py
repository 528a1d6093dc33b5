"""Tables written to a folder that all executors share, to end a lineage or fix a result."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset and Spark runs on one machine, a
    new local folder, which is then set. On a cluster a folder that all executors share is asked for."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-riffle-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Whether Spark deletes a query's shuffle files at its end; else they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """df as a table: computed once, read from the shared folder from then on. clean: what was shuffled for it goes at once."""
    path, conf = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.sparkSession.conf
    if not clean:
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew where it has fewer partitions than tasks run at once, as a table of one
    file does: for work that costs more than moving the rows. Large tables stay as they are."""
    most = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(most) if df.rdd.getNumPartitions() < most else df
