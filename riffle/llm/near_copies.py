"""Near copies: documents whose 5-word shingles have a Jaccard similarity of at least 0.8.

Candidates come from SimHash fingerprints in vantage-point trees, as in op1, but from
many: at 0.8 a bit differs with a probability of up to P, so one fingerprint of 64 bits is
about 10 bits off, a radius at which trees no longer prune. Short fingerprints, of a few
bits more than it takes to tell the documents apart, are within REACH of each other now
and then, and so many of them are searched, each in a tree of its own at that radius, that
a pair at 0.8 is missed by all with a probability below MISS. What a tree finds is held
against CHECK further bits of the SimHash, and the components of the links that pass are
the candidates.
Within a component all pairs are settled exactly, on the shingles of the texts: a prefix
filter on the component's rarest shingles loses no pair, and pairs already linked over
others are not compared. Equal sets of shingles are one class from the start.

A component of more than GROUP classes, or SHINGLES shingles, is taken apart first. 1 - Jaccard is a distance,
so its least document serves as vantage point: what is within 0.2 of it is linked, and of
that whatever is provably further than 0.2 from all the rest is settled. What stays open
is dealt into blocks of about that size, and every two blocks meet in a task of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, sent, staged
from .disjoint import Disjoint
from .simhash_vptree import SEED, blocks, build_tree, drop_grouped, grouped, route

WIDTH = 5
#: The most that a bit differs at a Jaccard similarity of 0.8: for 12 shingles in common and
#: 3 others (0.1515 for long texts); P_LEAST for a set of LEAST and one with a shingle more.
#: Different sets of fewer than LEAST are never so similar.
P, P_LEAST, LEAST = 0.1612, 0.1875, 4
MISS = 1e-6
REACH = 1
#: Bits that verify what a tree finds, and how many of them may differ (P, P_LEAST): a pair
#: at 0.8 exceeds them with a probability of 2e-7.
CHECK, MAX_OFF, MAX_OFF_LEAST = 128, 44, 50
#: Fingerprints at home in a shard of a tree, and about those that the driver sees to place the shards' boundaries.
SHARD, SAMPLE = 1 << 18, 1 << 14
_PAIRS = 1 << 18
_ROW = np.dtype([("key", "<u4"), ("check", "<u8", CHECK // 64), ("size", "<i4"), ("rep", "<i8"), ("home", "?")])
#: Classes of a component, and shingles of them, that one task settles, and about the most in a block of a larger one.
GROUP, SHINGLES = 512, 500_000
_CHUNK = 255  # what a byte counts


def shingles(text: bytes) -> np.ndarray:
    """Distinct hashes, in order, of the runs of WIDTH words; of all words if they are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = list(map(b" ".join, zip(*(words[i:] for i in range(WIDTH))))) or [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(runs)))


def forest(n: int) -> tuple[int, int, int]:
    """For n documents: bits of a tree's fingerprints, number of trees, and of trees with
    those that only the sets of LEAST and LEAST + 1 shingles visit."""
    bits = min(32, max(16, math.ceil(math.log2(max(n, 1))) + 2))

    def trees(p: float) -> int:
        hit = sum(math.comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(REACH + 1))
        return math.ceil(math.log(MISS) / math.log1p(-hit))

    return bits, trees(P), trees(P_LEAST)


def simhash_bits(h: np.ndarray, n: int) -> np.ndarray:
    """n bits (0, 1) of a SimHash of any length: 1 if set in over half of the shingles' hashes, drawn out by SplitMix64."""
    ones = np.zeros(n, np.int64)
    step = np.arange(1, -(-n // 64) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, len(h), _CHUNK):
        x = h[i : i + _CHUNK, None] + step
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1, count=n, bitorder="little").sum(0, dtype=np.uint8)
    return (2 * ones > len(h)).astype(np.uint8)


def sketch(h: np.ndarray, bits: int, trees: int, trees_least: int) -> bytes:
    """CHECK bits of the SimHash, then the key of each tree in 4 bytes; nothing of sets that have no near copy."""
    if len(h) < LEAST:
        return b""
    n = trees_least if len(h) <= LEAST + 1 else trees
    b = simhash_bits(h, CHECK + n * bits)
    keys = b[CHECK:].reshape(n, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))
    return np.packbits(b[:CHECK], bitorder="little").tobytes() + keys.astype("<u4").tobytes()


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, size, sketch): fp is a hash of the set of shingles, size their number; a null text counts as empty."""
    shape = forest(docs.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, size, cut = [], [], []
            for t in b.column(1).cast(pa.binary()):
                h = shingles(t.as_py() or b"")
                fp.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                size.append(len(h))
                cut.append(sketch(h, *shape))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(cut, pa.binary())], ["doc_id", "fp", "size", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long, size long, sketch binary")


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows x[i] and y[i] may be different sets at a similarity of 0.8, by their sizes and CHECK bits."""
    low, high = np.minimum(x["size"], y["size"]).astype(np.int64), np.maximum(x["size"], y["size"]).astype(np.int64)
    off = np.bitwise_count(x["check"] ^ y["check"]).sum(1, dtype=np.int64)
    return (5 * low >= 4 * high) & ((low < high) | (5 * (low - 1) >= 4 * (low + 1))) & (off <= np.where(low > LEAST, MAX_OFF, MAX_OFF_LEAST))


def search(rows: np.ndarray) -> Disjoint:
    """Join all rows, of a shard of a tree, whose keys are within REACH and that are alike, one of them at home."""
    keys, found = np.ascontiguousarray(rows["key"]), Disjoint(len(rows))
    root, left, right, many = found.roots(), [], [], 0
    for q, h in blocks(rows["home"], keys, REACH, _PAIRS):
        hit = np.bitwise_count(keys[q][:, None] ^ keys[h][None, :]) <= REACH
        if np.count_nonzero(hit) > 16 * len(q):  # a large group: only what isn't linked yet
            hit &= root[q][:, None] != root[h][None, :]
        a, b = np.divmod(np.flatnonzero(hit), len(h))
        a, b = q[a], h[b]
        a, b = a[a != b], b[a != b]
        near = _alike(rows[a], rows[b])
        if near.any():
            left.append(a[near])
            right.append(b[near])
            many += len(left[-1])
        if many > len(q):
            found.union(np.concatenate(left), np.concatenate(right))
            root, left, right, many = found.roots(), [], [], 0
    if left:
        found.union(np.concatenate(left), np.concatenate(right))
    return found


def candidates(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the reps of classes (rep, size, sketch) that span the components of what the trees find."""
    known = classes.where(F.length("sketch") > 0).select("rep", "size", "sketch")
    n = known.count()
    leaves = -(-n // SHARD)
    shapes: list[list[tuple[int, int, int, int]]] = []
    if leaves > 1:
        share = int(min(1.0, SAMPLE / n) * (1 << 30))
        picked = known.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) <= share).select("sketch").limit(2 * SAMPLE)
        sample = [np.frombuffer(r.sketch, "<u4")[CHECK // 32 :] for r in picked.collect()]
        for t in range(max(map(len, sample), default=0)):
            shapes.append(build_tree(np.array([s[t] for s in sample if len(s) > t], np.uint32), leaves))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [np.frombuffer(s, "<u4") for s in b.column(2).to_pylist()]
            if not cut:
                continue
            n_keys = np.array([len(s) - CHECK // 32 for s in cut])
            keys = np.zeros((n_keys.max(), len(cut)), np.uint32)
            for i, s in enumerate(cut):
                keys[: n_keys[i], i] = s[CHECK // 32 :]
            rows = np.zeros(len(cut), _ROW)
            rows["check"] = np.array([s[: CHECK // 32] for s in cut]).view("<u8")
            rows["size"], rows["rep"] = b.column(1).to_numpy(), b.column(0).to_numpy()
            tree, shard, pack = [], [], []
            for t, key in enumerate(keys):
                part = rows[n_keys > t]
                part["key"] = key[n_keys > t]
                shape = shapes[t] if t < len(shapes) else []
                at = np.empty(len(part), np.int64)
                at.put(*route(shape, part["key"], 0))
                row, leaf = route(shape, part["key"], REACH)
                for k in np.unique(leaf):
                    mine = part[row[leaf == k]]
                    mine["home"] = at[row[leaf == k]] == k
                    tree.append(t)
                    shard.append(int(k))
                    pack.append(mine.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(shard, pa.int32()), pa.array(pack, pa.binary())], ["tree", "shard", "pack"])

    def join(f: pd.DataFrame) -> pd.DataFrame:
        rows = np.frombuffer(b"".join(f["pack"]), _ROW)
        root = search(rows).roots()
        hit = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": rows["rep"][hit], "b": rows["rep"][root[hit]]})

    return known.mapInArrow(deal, "tree int, shard int, pack binary").groupBy("tree", "shard").applyInPandas(join, "a long, b long")


def link(sets: list[np.ndarray]) -> Disjoint:
    """Join all sets, none of them empty, whose Jaccard similarity is 0.8 or more."""
    size = np.array([len(s) for s in sets], np.int64)
    found = Disjoint(len(sets))
    _, flat, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    common = np.empty(len(count), bool)
    common[rank] = count > 1
    flat, owner = rank[flat], np.repeat(np.arange(len(sets)), size)
    flat = flat[np.lexsort((flat, owner))]  # rarest first
    start = np.concatenate([[0], np.cumsum(size)])
    # A partner shares at least 4/5 of the set, so one of the other shingles and one more.
    prefix = np.arange(len(flat)) - start[owner] < (size - -(-4 * size // 5) + 1)[owner]
    at = np.flatnonzero(prefix & common[flat])
    order = np.argsort(flat[at], kind="stable")  # by shingle, then set
    posted = owner[at][order]
    place = np.empty(len(at), np.int64)
    place[order] = np.arange(len(at))
    first = np.searchsorted(flat[at][order], flat[at])
    cuts = np.searchsorted(owner[at], np.arange(len(sets) + 1))
    mark = np.zeros(len(count), bool)
    for x in range(len(sets)):
        lists = [posted[first[i] : place[i]] for i in range(cuts[x], cuts[x + 1]) if first[i] < place[i]]
        if not lists:
            continue
        open_ = np.unique(np.concatenate(lists))
        open_ = open_[5 * np.minimum(size[open_], size[x]) >= 4 * np.maximum(size[open_], size[x])]
        mark[flat[start[x] : start[x + 1]]] = True
        many = 1
        while True:
            root = found.roots()
            open_ = open_[root[open_] != root[x]]
            if not len(open_):
                break
            # One of each group, and more and more of all where these don't link.
            now = np.union1d(np.unique(root[open_], return_index=True)[1], np.arange(min(many, len(open_))))
            y = open_[now]
            both = np.add.reduceat(mark[np.concatenate([flat[start[i] : start[i + 1]] for i in y])].astype(np.int64), np.concatenate([[0], np.cumsum(size[y])[:-1]]))
            y = y[9 * both >= 4 * (size[x] + size[y])]
            found.union(np.full(len(y), x), y)
            open_, many = np.delete(open_, now), 2 * many
        mark[flat[start[x] : start[x + 1]]] = False
    return found


def _vantage(members: DataFrame) -> DataFrame:
    """(doc_id, component, distance, near): of members (doc_id, text, component) from the
    member whose doc_id the component bears; near: Jaccard 0.8 or more."""
    point = members.where("doc_id = component").groupBy("component").agg(F.min("text").alias("point"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for b in batches:
            distance, near = [], []
            for text, point in zip(b.column(2), b.column(3)):
                if last[0] != point.as_py():
                    last = (point.as_py(), shingles(point.as_py()))
                x, y = shingles(text.as_py()), last[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                distance.append(1 - both / max(len(x) + len(y) - both, 1))
                near.append(len(x) > 0 and 9 * both >= 4 * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(distance, pa.float64()), pa.array(near, pa.bool_())], ["doc_id", "component", "distance", "near"])

    # The points are one row a component, so a large component is split where the join is skewed.
    return members.join(point, "component").select("doc_id", "component", "text", "point").mapInArrow(run, "doc_id long, component long, distance double, near boolean")


def near_links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the reps of classes (rep, size, sketch) that span the components of all near copies."""
    found = connected_components(candidates(classes))
    groups = staged(found.withColumnRenamed("node", "doc_id").join(classes.select(F.col("rep").alias("doc_id"), "size"), "doc_id"), "copies-groups")
    tasks = F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("size") / SHINGLES), F.lit(1)).cast("int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    large = groups.groupBy("component").agg(tasks.alias("blocks")).where("blocks > 1").select("component")
    dealt = groups.join(large, "component", "left_anti").select("doc_id", "component", F.lit(0).alias("i"), F.lit(0).alias("j"))
    linked = None
    if not large.isEmpty():
        seen = staged(_vantage(texts.join(sent(staged(groups.drop("size").join(large, "component"), "copies-large")), "doc_id")), "copies-vantage")
        linked = seen.where("near and doc_id <> component").select(F.col("doc_id").alias("a"), F.col("component").alias("b"))
        rest = seen.groupBy("component").agg(F.min(F.when(~F.col("near"), F.col("distance"))).alias("rest"))
        open_ = seen.join(rest, "component").where("not near or distance + 0.2 + 1e-9 >= rest").select("doc_id", "component").distinct().join(groups.select("doc_id", "size"), "doc_id")
        many = open_.groupBy("component").agg(tasks.alias("blocks"))
        parts = open_.join(many, "component").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        pairs = parts.select("doc_id", "component", "block", "blocks", other).where("other <> block or blocks = 1")
        dealt = dealt.unionByName(pairs.select("doc_id", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    # A doc_id with several texts brings them all; they are tied together anyway.
    members = texts.join(sent(staged(dealt, "copies-blocks")), "doc_id")

    def settle(f: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t) for t in f["text"]]
        full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
        if not len(full):
            return pd.DataFrame({"a": [], "b": []})
        ids = f["doc_id"].to_numpy(np.int64)[full]
        root = link([sets[i] for i in full]).roots()
        hit = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": ids[hit], "b": ids[root[hit]]})

    settled = members.groupBy("component", "i", "j").applyInPandas(settle, "a long, b long")
    return settled if linked is None else settled.unionByName(linked)


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): documents linked, over any number of steps, by a
    Jaccard similarity of 0.8 or more; component_id is the least doc_id reached.

    Null and empty texts are copies of each other. Rows that share a doc_id count as one
    document; a row without doc_id links with nothing and has a null component_id.
    """
    marked = staged(sketches(docs), "copies")
    classes = staged(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("sketch").alias("sketch")), "copies-class")
    return grouped(marked.select("doc_id", "fp"), classes.select("fp", "rep"), staged(near_links(docs, classes), "copies-links"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one document of each component of near_copies(): that with
    the least doc_id. Of rows that share a doc_id one stays; rows without stay all."""
    return drop_grouped(docs, staged(near_copies(docs).select("doc_id", "component_id"), "copies-found"))
