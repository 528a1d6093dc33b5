"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine c are sqrt(2 - 2c) apart, and no projection puts them further
apart. Vectors are projected on leading principal dimensions, put in the order of their
epsilon-grid cells and cut into blocks of consecutive vectors. Pairs of blocks of one
label whose bounding boxes are within epsilon are joined; within a pair of blocks the
sequences are halved recursively and intervals that are provably distant are skipped.
A pair of blocks returns for each vector its number of links and one edge towards its
group, never the pairs.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, looked_up, staged
from .disjoint import Disjoint
from .vectors import matrix, unit, usable

COSINE = 0.93
#: Leading dimensions of the grid; vectors that the driver sees to find them.
DIMS, SAMPLE = 8, 10_000
#: Vectors in a block, and in an interval that is compared at once.
BLOCK, LEAF = 2_048, 256
#: Leading dimensions whose cells blocks meet in.
MEET = 3
_SLACK = 1e-9


def _coordinates(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Projections of unit vectors, and the length of the rest: no two are further apart than the vectors."""
    p = x @ axes
    return np.column_stack([p, np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", p, p)))])


def principal(vectors: DataFrame, dim: int) -> np.ndarray:
    """Up to DIMS orthonormal directions of most variance, from a bounded sample.

    Any orthonormal directions give right results; these prune best."""
    n = vectors.count()
    part = vectors.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) <= int(min(1.0, SAMPLE / max(n, 1)) * (1 << 20))).limit(2 * SAMPLE)
    x = unit(np.array([r.embedding for r in part.select("embedding").collect()], np.float64).reshape(-1, dim))
    x = x - x.mean(0) if len(x) else x
    _, axes = np.linalg.eigh(x.T @ x)
    return axes[:, ::-1][:, :DIMS].copy()


def _far(p: np.ndarray, q: np.ndarray, eps: float) -> bool:
    gap = np.maximum(0.0, np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)))
    return bool(gap @ gap > eps * eps)


def _join(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, same: bool, eps: float, least: float, found: Disjoint, links: np.ndarray) -> None:
    """Add the links between sequences x and y (or within x) to links and found."""
    shift = 0 if same else len(x)
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d or same and a > c or _far(p[a:b], q[c:d], eps):
            continue
        if b - a > LEAF or d - c > LEAF:
            m, n = (a + b) // 2, (c + d) // 2
            if same and a == c:
                m = n
            if b - a <= LEAF:
                todo += [(a, b, c, n), (a, b, n, d)]
            elif d - c <= LEAF:
                todo += [(a, m, c, d), (m, b, c, d)]
            else:
                todo += [(a, m, c, n), (a, m, n, d), (m, b, c, n), (m, b, n, d)]
            continue
        hit = x[a:b] @ y[c:d].T >= least
        if same and a == c:
            np.fill_diagonal(hit, False)
        i, j = np.nonzero(hit)
        if not len(i):
            continue
        links[a:b] += hit.sum(1)
        if not (same and a == c):
            links[shift + c : shift + d] += hit.sum(0)
        found.union(i + a, j + c + shift)


def near_links(rows: DataFrame, cosine: float, dim: int, axes: np.ndarray) -> DataFrame:
    """(row, to, n): partial link counts n of each row, and an edge row - to, over the rows
    (row, label, embedding) of dim components."""
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + _SLACK
    k = axes.shape[1]
    cells = [f"c{i}" for i in range(k)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grid = np.floor(unit(matrix(b.column(2), dim)) @ axes / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(grid[:, i]) for i in range(k))], ["row", "label", "embedding", *cells])

    kind = rows.schema["label"].dataType.simpleString()
    item = rows.schema["embedding"].dataType.simpleString()
    placed = rows.select("row", "label", "embedding").mapInArrow(place, f"row long, label {kind}, embedding {item}, " + ", ".join(f"{c} int" for c in cells))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block(part: list[tuple]) -> pa.RecordBatch:
            x = unit(np.stack([t[2] for t in part]))
            at = _coordinates(x, axes)
            lo, hi = at.min(0), at.max(0)
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([part[0][1]], label_type), pa.array([lo.tolist()]), pa.array([hi.tolist()]),
                 pa.array([np.array([t[0] for t in part], np.int64).tobytes()]), pa.array([np.stack([t[2] for t in part]).tobytes()])],
                ["block", "label", "lo", "hi", "ids", "vectors"],
            )

        label_type = None
        for b in batches:
            label_type = b.column(1).type
            x = matrix(b.column(2), dim)
            for row, label, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), x):
                if held and (held[0][1] != label or len(held) == BLOCK):
                    yield block(held)
                    held = []
                held.append((row, label, v))
        if held:
            yield block(held)

    n = rows.count()
    ordered = placed.repartitionByRange(max(1, -(-n // (4 * BLOCK))), "label", *cells, "row").sortWithinPartitions("label", *cells, "row")
    blocks = staged(
        ordered.select("row", "label", "embedding").mapInArrow(pack, f"block string, label {kind}, lo array<double>, hi array<double>, ids binary, vectors binary"),
        "ego-blocks",
    )
    # Blocks meet in the cells of leading dimensions that both reach, and count in the first such cell.
    meta, meet = blocks.select("block", "label", "lo", "hi"), [f"m{i}" for i in range(min(MEET, k))]
    cell = lambda c, i, by: F.floor((F.col(c)[i] + by) / eps).cast("int")
    left = meta.select(F.col("block").alias("a"), "label", F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), *[cell("lo", i, 0.0).alias(f"a{i}") for i in range(len(meet))])
    right = meta.select(F.col("block").alias("b"), "label", F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), *[cell("lo", i, -eps).alias(f"b{i}") for i in range(len(meet))])
    for i, m in enumerate(meet):
        left = left.withColumn(m, F.explode(F.sequence(F.col(f"a{i}"), cell("hi_a", i, 0.0))))
        right = right.withColumn(m, F.explode(F.sequence(F.col(f"b{i}"), cell("hi_b", i, eps))))
    gap = lambda i: F.greatest(F.lit(0.0), F.col("lo_a")[i] - F.col("hi_b")[i], F.col("lo_b")[i] - F.col("hi_a")[i])
    near = (F.col("a") <= F.col("b")) & (sum((gap(i) * gap(i) for i in range(1, k + 1)), gap(0) * gap(0)) <= eps * eps)
    for i, m in enumerate(meet):
        near &= F.col(m) == F.greatest(f"a{i}", f"b{i}")
    pairs = left.join(right, ["label", *meet]).where(near).select("a", "b")
    both = pairs.join(blocks.select(F.col("block").alias("a"), F.col("ids").alias("ids_a"), F.col("vectors").alias("va")), "a").join(
        blocks.select(F.col("block").alias("b"), F.col("ids").alias("ids_b"), F.col("vectors").alias("vb")), "b"
    )

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for t in f.itertuples(index=False):
                same = t.a == t.b
                ids = np.frombuffer(t.ids_a, np.int64)
                x = unit(np.frombuffer(t.va, np.float64).reshape(-1, dim))
                y = x if same else unit(np.frombuffer(t.vb, np.float64).reshape(-1, dim))
                ids = ids if same else np.concatenate([ids, np.frombuffer(t.ids_b, np.int64)])
                found, links = Disjoint(len(ids)), np.zeros(len(ids), np.int64)
                _join(x, y, _coordinates(x, axes), _coordinates(y, axes), same, eps, cosine, found, links)
                at = np.flatnonzero(links)
                yield pd.DataFrame({"row": ids[at], "to": ids[found.roots()[at]], "n": links[at]})

    return both.select("a", "b", "ids_a", "va", "ids_b", "vb").mapInPandas(compare, "row long, to long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Rows link when their labels are equal and not null, their vectors have as many
    components, and their cosine is `cosine` or more. A null vector, one of zeros, or one
    with a null or non-finite component links with nothing. Rows that share a vec_id are
    vectors of their own. component_id is the least vec_id of the rows linked, over any
    number of steps; kept marks rows that bear it. Other columns are ignored.
    """
    rows = staged(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "embedding"), "vectors")
    good = rows.where(usable() & F.col("label").isNotNull())
    dims = [r["d"] for r in good.select(F.size("embedding").alias("d")).distinct().collect()]  # the lengths of vectors that occur
    links = None
    for d in sorted(dims):
        part = good.where(F.size("embedding") == d)
        got = near_links(part, cosine, d, principal(part, d))
        links = got if links is None else links.unionAll(got)
    ids = rows.select("row", "vec_id")
    if links is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    links = staged(links, "ego-links")
    groups = connected_components(links.select(F.col("row").alias("a"), F.col("to").alias("b")).where("a != b"))
    named = staged(groups.join(ids, F.col("node") == F.col("row")).select("row", "component", "vec_id"), "ego-groups")
    least = looked_up(named, named.groupBy("component").agg(F.min("vec_id").alias("component_id")), "component").select("row", "component_id")
    counts = links.groupBy("row").agg(F.sum("n").alias("n_links"))
    return (
        ids.join(counts, "row", "left")
        .join(least, "row", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
