"""Approximate nearest neighbours by a permutation index.

A vector is represented by its NEAR nearest pivots, in order. The table is dealt into
blocks; within a block every pivot has an inverted file of the vectors that have it among
theirs, with its place in their order. A query reads the files of its own NEAR pivots
only: a vector that shares a pivot gains 2 (NEAR - max(its place, the query's)), and the
sum of gains is what the truncated footrule distance falls short of that of vectors
without a common pivot. The share of the block that ranks best, ties included, is
reranked by cosine on the original vectors.

Vectors are shuffled once, to their blocks; queries, a stated subset, are sent to each
block in packs. Beyond CHUNK queries a block is met by one chunk of them after the other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import norms, unit, usable

#: Pivots, drawn from the table; pivots that a vector is posted under and a query reads.
PIVOTS, NEAR = 512, 48
#: Vectors of a block; queries of a pack, and of a chunk that meets a block at once.
BLOCK, PACK, CHUNK = 8_192, 1_024, 65_536
#: The part of each block, and the least number of its vectors, that are reranked.
SHARE, LEAST = 0.10, 256


def pivots(vectors: DataFrame, dim: int, count: int = PIVOTS) -> np.ndarray:
    """Unit pivots: the vectors with the least hashes, filled up with seeded random directions."""
    got = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).select("embedding").collect()
    x = np.array([r.embedding for r in got], np.float64).reshape(-1, dim)
    more = np.random.default_rng(dim).standard_normal((count - len(x), dim))
    return unit(np.concatenate([x, more]))


def nearest(x: np.ndarray, piv: np.ndarray, near: int = NEAR) -> np.ndarray:
    """The near nearest pivots of each vector, nearest first."""
    return np.argsort(-(unit(x) @ piv.T), axis=1, kind="stable")[:, :near]


class Files:
    """The inverted files of a block: for each pivot, the vectors posted and their places."""

    def __init__(self, order: np.ndarray, pivots: int):
        n, self.near = order.shape
        by_pivot = np.argsort(order.ravel(), kind="stable")
        self.vector, self.place = np.divmod(by_pivot, self.near)
        self.cuts = np.searchsorted(order.ravel()[by_pivot], np.arange(pivots + 1))
        self.size = n

    def gains(self, order: np.ndarray) -> np.ndarray:
        """Of each vector, from the files of a query's pivots."""
        at = [slice(self.cuts[p], self.cuts[p + 1]) for p in order]
        vector = np.concatenate([self.vector[a] for a in at])
        gain = np.concatenate([self.near - np.maximum(self.place[a], j) for j, a in enumerate(at)])
        return np.bincount(vector, gain, self.size)


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, files: Files, piv: np.ndarray, k: int, share: float) -> list[tuple[int, int, float]]:
    """The k best of a block for each query: (query, vec, cosine)."""
    out = []
    asked = nearest(q, piv)
    size, q_size = norms(x), norms(q)
    want = max(LEAST, int(np.ceil(share * len(ids))))
    for i, (qid, v) in enumerate(zip(q_ids, q)):
        if want < len(ids):
            gain = files.gains(asked[i])
            near = np.flatnonzero(gain >= np.partition(gain, -want)[-want])
        else:
            near = np.arange(len(ids))
        near = near[ids[near] != qid]
        score = np.einsum("ij,j->i", x[near], v) / (size[near] * q_size[i])
        best = np.lexsort((ids[near], -score))
        # Repeated rows of a vector are found once.
        _, first = np.unique(ids[near[best]], return_index=True)
        out += [(qid, int(ids[near[j]]), float(score[j])) for j in best[np.sort(first)][:k]]
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 5, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, best first.

    Vectors that are null, zero, hold null or non-finite components, or lack a vec_id
    take no part, as queries or candidates; a query is never its own candidate, nor is a
    repeated row with its vec_id; repeated rows of a candidate are found once. Vectors of
    another length than the query's are not compared. Other columns are ignored.
    """
    good = vectors.where(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    dims = sorted(r["d"] for r in good.select(F.size("embedding").alias("d")).distinct().collect())  # the lengths that occur
    found = None
    for dim in dims:
        part = good.where(F.size("embedding") == dim)
        got = _search_dim(part, part.where(is_query), dim, k, share)
        found = got if found is None else found.unionAll(got)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_dim(vectors: DataFrame, asked: DataFrame, dim: int, k: int, share: float) -> DataFrame:
    piv = pivots(vectors, dim)
    n, m = vectors.count(), asked.count()
    blocks, chunks, packs = max(1, -(-n // BLOCK)), max(1, -(-m // CHUNK)), max(1, -(-m // PACK))
    # The rows of a vec_id that is repeated very often are dealt by partition, too.
    block = F.pmod(F.xxhash64("vec_id", F.spark_partition_id()), F.lit(blocks)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    index = vectors.withColumn("block", block)
    index = index.withColumn("chunk", every(chunks)) if chunks > 1 else index.withColumn("chunk", F.lit(0))

    def pack(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(f["embedding"].to_numpy()).astype(np.float64)
        return pd.DataFrame({"pack": [key[0]], "ids": [f["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()]})

    distinct = asked.dropDuplicates(["vec_id", "embedding"])
    packed = distinct.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(packs)).cast("int").alias("pack")).applyInPandas(pack, "pack int, ids binary, vectors binary")
    sent = packed.withColumn("block", every(blocks)).withColumn("chunk", F.col("pack") % chunks)

    def meet(key: tuple, f: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        got: list[tuple[int, int, float]] = []
        if len(f):
            ids, x = f["vec_id"].to_numpy(np.int64), np.stack(f["embedding"].to_numpy()).astype(np.float64)
            files = Files(nearest(x, piv), len(piv))
            for t in queries.itertuples(index=False):
                got += search_block(np.frombuffer(t.ids, np.int64), np.frombuffer(t.vectors, np.float64).reshape(-1, dim), ids, x, files, piv, k, share)
        return pd.DataFrame(got, columns=["query_id", "vec_id", "score"])

    return index.groupBy("block", "chunk").cogroup(sent.groupBy("block", "chunk")).applyInPandas(meet, "query_id long, vec_id long, score double")
