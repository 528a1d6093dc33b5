"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.operators.tables import shared_dir
from riffle.operators.tables import written as staged

#: A word is a run of bytes other than space and 0x09-0x0D: what bytes.split() yields.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a few numbers each that are broadcast at most.
SENT = 2_000_000


def sent(rows: DataFrame) -> DataFrame:
    """rows (of numbers), to be broadcast to what they are joined with where they are few;
    beyond SENT the join deals out both sides."""
    return F.broadcast(rows) if rows.limit(SENT + 1).count() <= SENT else rows


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows, a written table, inner-joined with table, which holds each key once.

    Keys of more than a ten-thousandth of the rows, so 10,000 keys at most, are broadcast
    with what table says of them; the rest is an even join."""
    n = rows.count()
    if n <= 256:
        return rows.join(table, key)
    most = max(256, n // 10_000)
    hot = staged(rows.groupBy(key).count().where(F.col("count") > most).select(key), "hot")
    if hot.isEmpty():
        return rows.join(table, key)
    few = F.broadcast(table.join(F.broadcast(hot), key))
    return rows.join(few, key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the graph of edges (a, b); component is its smallest node.

    Randomised contraction: each round maps every node to the neighbour (or itself)
    whose hash is least and relabels the edges. Hashes put the nodes in random order, so
    chains shrink by a constant factor a round, and a star is gone after two. Then the
    maps are applied one after the other. Minima are combined before they are shuffled,
    and hubs and large components are looked up apart.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    left = staged(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges"
    )
    steps = []
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), rank("b").alias("r")).unionAll(
            left.select(F.col("b").alias("node"), rank("a").alias("r"))
        )
        step = staged(
            both.groupBy("node").agg(F.min("r").alias("r")).select("node", F.least("r", rank("node"))["n"].alias("to")),
            "contract",
        )
        steps.append(step)
        once = staged(looked_up(left, step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").select("b", "ta"), "edges")
        left = staged(
            looked_up(once, step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .where("a < b")
            .distinct(),
            "edges",
        )
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = steps[0].select("node", F.col("to").alias("root"))
    for step in steps[1:]:
        # A node without edges is its own root from then on.
        roots = staged(labels.select("root").distinct().join(step.withColumnRenamed("node", "root"), "root", "left").select("root", F.coalesce("to", "root").alias("to")), "roots")
        labels = staged(looked_up(staged(labels, "labels"), roots, "root").select("node", F.col("to").alias("root")), "labels")
    labels = staged(labels, "labels")
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return looked_up(labels, least, "root").select("node", "component")


def staged_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """df as a table in the shared folder, bucketed by key: it is grouped or joined by key
    without being shuffled. As many buckets as the session has shuffle partitions."""
    spark = df.sparkSession
    table = f"{name}-{uuid.uuid4().hex}".replace("-", "_")
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.bucketBy(buckets, key).option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)
