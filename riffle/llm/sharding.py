"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows are numbered by (doc_id, text checksum, size); a four-round Feistel network over
Z_a x Z_b, with a * b just above the row count, permutes the numbers and walks the
cycle until it is back below the row count. Shard and slot follow from the permuted
number by arithmetic: shard = p mod shards, slot = p div shards. Only DataFrame
functions are used.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Multiplier and increment of each round, and the primes that the round function mixes by.
ROUND_KEYS = [(1103515245, 12345), (1664525, 1013904223), (69069, 362437), (1812433253, 2531011)]
PRIMES = (2147483647, 4294967291)
#: Rows in a number range that one task sorts.
RANGE = 1_000_000
WALK = 16


def round_value(x: Column, key: int) -> Column:
    """Mix x (below 2**31) with round key; all products stay below 2**63."""
    a, b = ROUND_KEYS[key]
    y = (x * F.lit(a) + F.lit(b)) % F.lit(PRIMES[0])
    return (y * y) % F.lit(PRIMES[1]) + y


def feistel(x: Column, a: int, b: int) -> Column:
    """Permute 0 .. a*b-1; four rounds on the halves x div b and x mod b."""
    left, right = (x - x % F.lit(b)) / F.lit(b), x % F.lit(b)
    s = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    for k in range(len(ROUND_KEYS)):
        s = _bind(s, _round(k, a, b))
    return _bind(s, lambda p: p["l"] * F.lit(b) + p["r"])


def _round(key: int, a: int, b: int) -> Callable[[Column], Column]:
    """One round: even keys change the left half, odd ones the right half."""
    if key % 2 == 0:
        return lambda p: F.struct(((p["l"] + round_value(p["r"], key)) % F.lit(a)).alias("l"), p["r"].alias("r"))
    return lambda p: F.struct(p["l"].alias("l"), ((p["r"] + round_value(p["l"], key)) % F.lit(b)).alias("r"))


def _bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def permute(x: Column, n: int) -> Column:
    """Position of row number x, 0 .. n-1, after the shuffle.

    A walk visits each of the a*b - n numbers beyond the rows once at most, so that many
    steps always end it. Nearly every walk ends within WALK; only the others, about one
    row in n**8, take the longer loop."""
    b = max(1, math.isqrt(max(n - 1, 0)) + 1)
    a = max(1, -(-n // b))

    def walk(start: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, steps))), start, lambda p, _: F.when(p < F.lit(n), p).otherwise(feistel(p, a, b)))

    beyond = a * b - n
    short = walk(feistel(x, a, b), min(WALK, beyond))
    return short if beyond <= WALK else _bind(short, lambda p: F.when(p < F.lit(n), p).otherwise(walk(p, beyond)))


def number_rows(df: DataFrame, keys: list[str], name: str = "row_no") -> DataFrame:
    """Gapless row numbers from 0 in the order of keys, without one global sort task.

    Rows are dealt into ranges of the keys and staged once; the ranges' counts give each
    its first number. Rows equal in all keys get their numbers in any order, and
    all in one range.
    """
    n = df.count()
    parts = max(1, -(-n // RANGE), min(64, n // 20_000))
    order_by = [F.col(k).asc_nulls_last() for k in keys]
    dealt = staged(df.repartitionByRange(parts, *order_by).withColumn("_part", F.spark_partition_id()), "ranges")
    # One row for each range, about rows / RANGE of them.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    start = staged(sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")), "starts")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order_by))
    return dealt.withColumn("_n", within).join(start, "_part").withColumn(name, F.col("_start") + F.col("_n") - 1).drop("_part", "_start", "_n")


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, row_no, shard, slot) for each row of docs.

    The law is `rows`: the shards' counts differ by one at most. size is the UTF-8 length
    of text plus 1; a null text counts as empty. Equal rows, null doc_ids and repeated
    doc_ids are rows like any other: each gets its own slot. Same rows, same result,
    whatever their order or partitions.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    slim = staged(
        docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32")), "slim"
    )
    # Rows equal in all three are dealt on by their place in the staged files: they may change
    # places without changing the result, and however many there are, no range holds them all.
    slim = slim.select("*", F.col("_metadata.row_index").alias("_place"))
    n = slim.count()
    if n >= 1 << 62:
        raise ValueError("row numbers beyond 62 bits")
    rows = number_rows(slim, ["doc_id", "text_crc32", "size", "_place"])
    placed = rows.withColumn("_p", permute(F.col("row_no"), n))
    return placed.select(
        "doc_id", "size", "text_crc32", "row_no",
        (F.col("_p") % shards).cast("int").alias("shard"),
        ((F.col("_p") - F.col("_p") % shards) / shards).cast("long").alias("slot"),
    )
