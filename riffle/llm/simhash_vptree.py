"""SimHash near-duplicates, searched exactly through vantage-point trees.

A pair of 64-bit fingerprints within 3 bits is within 1 bit on its low or its high 32
bits. Hamming distance on either half is a metric, so each half gets a vantage-point
tree with search radius 1 (a single tree over 64 bits would need radius 3, which
reaches over most boundaries: distances of unrelated fingerprints spread by 4 bits
only). Hits are verified on all 64 bits, so the result is exact.

The top of each tree is built from a bounded sample and decides only how evenly the
shards are filled. Every fingerprint has a home shard and also visits each shard whose
boundary lies within the radius; within a shard a local tree prunes the same way. A
shard emits a spanning forest of its links, never its pairs, so groups of thousands of
near copies cost a row for each member.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, looked_up, sent, staged
from .disjoint import Disjoint

SEED = 42
BITS = 3
#: Fingerprints that the driver sees, about, to place the shards' boundaries.
SAMPLE = 40_000
#: Fingerprints at home in a shard.
SHARD = 8_192
_CHUNK = 1 << 16
_BRUTE = 1 << 20


def simhash(text: bytes, width: int = 3) -> int:
    """Fingerprint of UTF-8 text: bit i is 1 if set in over half the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _CHUNK):
        part = h[i : i + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            out = np.fromiter((simhash(t.as_py() or b"", width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _halves(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp & np.uint64(0xFFFFFFFF)).astype(np.uint32), (fp >> np.uint64(32)).astype(np.uint32)]


def _distance(x: np.ndarray, v: int) -> np.ndarray:
    return np.bitwise_count(x ^ x.dtype.type(v)).astype(np.int16)


def _split(x: np.ndarray) -> tuple[int, int] | None:
    """Vantage point and radius that halve x best, of a few candidates tried on every n-th of x; None if all are equal."""
    best = None
    some = x[:: max(1, len(x) >> 9)]
    for v in x[np.linspace(0, len(x) - 1, 5).astype(int)]:
        for cand in (v, ~v, v ^ x.dtype.type(0x0F0F0F0F)):
            upto = np.cumsum(np.bincount(_distance(some, int(cand)), minlength=8 * x.itemsize + 2)).tolist()
            mu = bisect_left(upto, (len(some) + 1) // 2)
            for m in (mu - 1, mu):
                inside = upto[m] if m >= 0 else 0
                if 0 < inside < len(some):
                    over = upto[m + 1] - (upto[m - 1] if m else 0)
                    cost = max(inside, len(some) - inside) + over / 2
                    if best is None or cost < best[0]:
                        best = (cost, int(cand), m)
    if best is None and len(some) < len(x):
        return _split(np.unique(x))
    return best and best[1:]


def build_tree(x: np.ndarray, leaves: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, radius, inside, outside); a child below 0 is leaf -child-1."""
    nodes: list[tuple[int, int, int, int]] = []
    n_leaves = 0

    def grow(part: np.ndarray, want: int) -> int:
        nonlocal n_leaves
        cut = _split(part) if want > 1 and len(part) > 1 else None
        if cut is None:
            n_leaves += 1
            return -n_leaves
        at = len(nodes)
        nodes.append((0, 0, 0, 0))
        inside = _distance(part, cut[0]) <= cut[1]
        nodes[at] = (*cut, grow(part[inside], want // 2), grow(part[~inside], want - want // 2))
        return at

    grow(np.unique(x), leaves)
    return nodes


def route(nodes: list[tuple[int, int, int, int]], x: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for each leaf that a ball of radius reach around x[row] may touch."""
    rows, leaves = [], []
    todo = [(0 if nodes else -1, np.arange(len(x)))]
    while todo:
        at, idx = todo.pop()
        if not len(idx):
            continue
        if at < 0:
            rows.append(idx)
            leaves.append(np.full(len(idx), -at - 1))
            continue
        v, mu, inside, outside = nodes[at]
        d = _distance(x[idx], v)
        todo.append((inside, idx[d <= mu + reach]))
        todo.append((outside, idx[d > mu - reach]))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(leaves)


def blocks(home: np.ndarray, keys: np.ndarray, reach: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (any, at home), in blocks of about most pairs: each pair of keys within reach is in one."""
    todo = [(np.flatnonzero(home), np.arange(len(keys)))]
    while todo:
        h, q = todo.pop()
        if not len(h) or not len(q):
            continue
        cut = _split(keys[h]) if len(h) > 64 and len(h) * len(q) > most else None
        if cut is None:
            step = max(1, most // len(h))
            for i in range(0, len(q), step):
                yield q[i : i + step], h
            continue
        v, mu = cut
        dh, dq = _distance(keys[h], v), _distance(keys[q], v)
        todo.append((h[dh <= mu], q[dq <= mu + reach]))
        todo.append((h[dh > mu], q[dq > mu - reach]))


def _search(fp: np.ndarray, home: np.ndarray, keys: np.ndarray, reach: int, found: Disjoint) -> None:
    """Join all rows within BITS of each other, one of which is at home."""
    for part, h in blocks(home, keys, reach, _BRUTE):
        a, b = np.nonzero(np.bitwise_count(fp[part][:, None] ^ fp[h][None, :]) <= BITS)
        a, b = part[a], h[b]
        found.union(a[a != b], b[a != b])


def near_links(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the reps of classes (fp, rep) whose fps differ in 3 bits or fewer.

    They span the same components as all such pairs do.
    """
    n = classes.count()
    share = min(1.0, SAMPLE / max(n, 1))
    picked = classes.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("fp").limit(2 * SAMPLE)
    sample = np.sort(np.array([r.fp for r in picked.collect()], np.int64)).view(np.uint64)
    trees = [build_tree(x, max(1, -(-n // SHARD))) for x in _halves(sample)]

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = f["fp"].to_numpy(np.int64)
            for k, x in enumerate(_halves(fp.view(np.uint64))):
                at = np.empty(len(x), np.int64)
                at.put(*route(trees[k], x, 0)) if len(x) else None
                row, leaf = route(trees[k], x, 1)
                yield pd.DataFrame({"tree": k, "shard": leaf, "fp": fp[row], "rep": f["rep"].to_numpy()[row], "home": at[row] == leaf})

    def join(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        fp = f["fp"].to_numpy(np.int64).view(np.uint64)
        rep = f["rep"].to_numpy(np.int64)
        ids, where = np.unique(rep, return_inverse=True)
        found = Disjoint(len(fp))
        _search(fp, f["home"].to_numpy(bool), _halves(fp)[key[0]], 1, found)
        root = found.roots()
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": ids[where[linked]], "b": ids[where[root[linked]]]})

    dealt = classes.mapInPandas(deal, "tree int, shard long, fp long, rep long, home boolean")
    return dealt.groupBy("tree", "shard").applyInPandas(join, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): documents linked, over any number of steps, by
    fingerprints that differ in 3 bits or fewer; component_id is the least doc_id reached.

    Null and empty texts have fingerprint zero and link like any other. Rows that share a
    doc_id count as one document. A row without doc_id keeps its fingerprint, links with
    nothing and has a null component_id. Other columns are ignored.
    """
    marked = staged(fingerprints(docs, width).withColumn("doc_id", F.col("doc_id").cast("long")), "simhash")
    classes = staged(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-class")
    return grouped(marked, classes, near_links(classes))


def grouped(marked: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of rows (doc_id, fp) under links between the reps of classes (fp, rep)."""
    # A doc_id with several texts stands in several classes: tie them together.
    twice = marked.where("doc_id is not null").distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    ties = (
        marked.join(twice.select("doc_id"), "doc_id").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    )
    groups = connected_components(links.unionByName(ties))
    named = classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        "fp", F.coalesce("component", "rep").alias("component")
    )
    # Very many rows may share a fingerprint; rows without doc_id have no component.
    found = looked_up(marked.where("doc_id is not null"), named, "fp").select("doc_id", "fp", F.col("component").alias("component_id"))
    return found.unionByName(marked.where("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id")))


def drop_near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs, all columns, with one document of each component of near_duplicates(): that
    with the least doc_id. Of rows that share a doc_id one stays; rows without stay all."""
    return drop_grouped(docs, staged(near_duplicates(docs, width).select("doc_id", "component_id"), "simhash-found"))


def drop_grouped(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without those whose component_id in found (doc_id, component_id) is another document's."""
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(sent(gone), "doc_id", "left_anti").select(docs.columns)
    twice = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return kept.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(once)
