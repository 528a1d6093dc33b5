"""Mix sources to target weights by hash thresholds.

Every document has a 60-bit hash. A source whose target is k whole epochs and a rest
takes each document k times, and once more those whose hash is at most a threshold.
The threshold is found from histograms: tokens summed by source and the hash's leading
10 bits, then only the bucket that holds the budget's boundary is refined by the next
10 bits, until it holds one hash. Thresholds for smaller budgets are nested in those
for larger ones, and documents are filtered, never sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

HASH_BITS, STEP_BITS = 60, 10


def doc_hash() -> Column:
    """60 bits of the MD5 of doc_id (of the text where doc_id is null)."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, share: float = 1.0) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Sources in code point order, null last, weigh `weights`, repeating. Targets share
    `share` of all sizes by weight, stop at cap times their source's size, and what is
    above is shared again by weight. The windows run over one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(int(w)) for w in weights])
    s = sizes.withColumn("weight", F.element_at(table, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * F.lit(cap)
    by_cap = Window.orderBy((limit / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    upto, every = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (
        s.withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("capped", F.coalesce(F.sum(limit).over(upto), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    )
    # The first source, in this order, whose share of what is left fits under its cap sets the level for the rest.
    fits = F.col("weight") * ((F.col("budget") - F.col("capped")) / F.col("open_weight")) <= limit
    first = F.min(F.when(fits, F.struct("capped", "open_weight"))).over(every)
    level = (F.col("budget") - first["capped"]) / first["open_weight"]
    target = F.when(first.isNull() | (F.col("capped") < first["capped"]) & ~fits, limit.cast("double")).otherwise(F.least(limit.cast("double"), F.col("weight") * level))
    return s.select("source", "source_size", "weight", target.alias("target"))


def _bucket(bits: int) -> Column:
    return F.shiftright("h", HASH_BITS - bits)


def thresholds(slim: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): the rows of slim (source, size, h) with h <= threshold come
    nearest to the source's budget; budgets: (source, rest)."""
    first = budgets.where("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("prefix"))
    level, done, open_ = 0, None, staged(first, "mix-bounds")
    while not open_.isEmpty():
        bits = level * STEP_BITS
        o = open_.select(F.col("source").alias("o_source"), "rest", "prefix")
        inside = slim.join(o, F.col("source").eqNullSafe(F.col("o_source")) & (_bucket(bits) == F.col("prefix")))
        hist = inside.groupBy("source", "rest", _bucket(bits + STEP_BITS).alias("prefix")).agg(
            F.sum("size").alias("tokens"), F.min("h").alias("lo"), F.max("h").alias("hi")
        )
        run = Window.partitionBy("source").orderBy("prefix")  # at most 2**STEP_BITS rows a source
        found = (
            hist.withColumn("upto", F.sum("tokens").over(run))
            .where("upto >= rest and upto - tokens < rest")
            .select("source", (F.col("rest") - (F.col("upto") - F.col("tokens"))).alias("rest"), "prefix", "tokens", "lo", "hi")
        )
        found = staged(found, "mix-bounds")
        nearest = F.when(F.col("tokens") - F.col("rest") < F.col("rest"), F.col("hi")).otherwise(F.col("lo") - 1)
        ended = found.where("lo = hi").select("source", nearest.alias("threshold"))
        done = ended if done is None else done.unionAll(ended)
        open_, level = found.where("lo < hi").select("source", "rest", "prefix"), level + 1
    return budgets.select("source", F.lit(-1).cast("long").alias("threshold")).limit(0) if done is None else done


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h), staged: what the mix reads again and again, without the texts."""
    return staged(docs.select("doc_id", "source", word_count().alias("size"), doc_hash().alias("h")), "mix")


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def source_plan(slim: DataFrame, weights: Sequence[int], cap: int, share: float) -> DataFrame:
    """One row for each source: (p_source, source_size, target, whole, threshold)."""
    totals = staged(slim.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = staged(
        source_targets(totals, weights, cap, share)
        .withColumn("whole", F.least(whole, F.lit(cap)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix-targets",
    )
    bounds = thresholds(slim, targets.select("source", "rest")).select(F.col("source").alias("b_source"), "threshold")
    plan = targets.join(bounds, F.col("source").eqNullSafe(F.col("b_source")), "left").select(
        F.col("source").alias("p_source"), "source_size", "target", "whole", F.coalesce("threshold", F.lit(-1)).alias("threshold")
    )
    return staged(plan, "mix-plan")


def _copies() -> Column:
    return (F.col("whole") + F.when(F.col("h") <= F.col("threshold"), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, share: float = 1.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies) for each row of docs.

    size is the text's number of words (null: 0), copies how often the mix takes the
    document, taken = size * copies. Null sources form a source of their own, the last.
    Rows that share a doc_id share a hash and are taken alike; an empty table gives no
    rows; a source without words has target 0. The result depends on the rows alone.
    """
    slim = sizes(docs)
    plan = source_plan(slim, weights, cap, share)
    both = slim.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("copies", _copies())
    return both.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def resample(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, share: float = 1.0) -> DataFrame:
    """docs, all columns, with each row as often as mix() takes it, 0 to cap times. The
    plan, a row for each source, meets the documents where they are read. Documents
    without words, which no budget counts, are taken with the rest of their hash range."""
    plan = source_plan(sizes(docs), weights, cap, share).drop("source_size", "target")
    names = docs.columns
    both = docs.withColumn("_doc", F.struct(*names)).select("_doc", F.col("source").alias("_source"), doc_hash().alias("h"))
    taken = both.join(plan, F.col("_source").eqNullSafe(F.col("p_source"))).withColumn("copies", _copies()).where("copies > 0")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select([F.col("_doc")[n].alias(n) for n in names])
