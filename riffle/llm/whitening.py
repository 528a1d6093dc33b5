"""Embedding whitening by matrix-free block Lanczos.

Vectors are rounded to integers; the fit list holds each distinct integer vector once, in
packed blocks of a written table. The covariance V is never formed: a pass over the blocks
centres each vector, multiplies by a few columns and sums x (x'v) over the tasks, so that
the driver sees only the sums, as many numbers as the columns have. Around these passes
runs block Lanczos with full reorthogonalisation. A block that loses rank (a breakdown) is
filled with new random directions; a full basis is restarted from its best Ritz vectors.
It ends when the residuals |V y - e y| of the wanted pairs are at the rounding error of a
pass, or when the basis spans the whole space. The trace of V, which gives explained
shares, is the sum of the exact deviations. Vectors of different lengths are spaces of
their own, which the same passes serve together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged
from .vectors import finite, matrix

#: Components wanted; columns of a pass; columns of the basis at most, in blocks; passes at most.
COMPONENTS, WIDTH, BASIS, PASSES = 4, 8, 12, 500
#: Residuals, and least eigenvalue of a component, as shares of the largest eigenvalue.
TOLERANCE, LEAST = 1e-13, 1e-12
#: Vectors in a packed block.
PACK = 4_096
SCALE = 256.0


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as longs; beyond the range of a long, its end."""
    y, top = np.floor(SCALE * x), np.iinfo(np.int64)
    return np.where(y >= 2.0**63, top.max, np.where(y < -(2.0**63), top.min, np.clip(y, -(2.0**62), 2.0**62).astype(np.int64)))


def _packed(x: np.ndarray) -> tuple[str, np.ndarray]:
    """The narrowest type that holds x: the same for equal vectors."""
    kind = "<i2" if len(x) == 0 or (x.min() >= -(1 << 15) and x.max() < 1 << 15) else "<i8"
    return kind, x.astype(kind)


@dataclass
class Fit:
    """Vectors of one length: count, sums, and the eigenpairs found."""

    n: int
    sums: list[int]
    values: np.ndarray | None = None
    vectors: np.ndarray | None = None
    trace: float = 0.0
    error: float = 0.0

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x - S/n, and n*x - S in exact integers (longs where they fit, else Python's)."""
        most = self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, self.sums), default=0)
        if most < 1 << 62:
            d = x * self.n - np.array(self.sums, np.int64)
            return d / self.n, d
        d = x.astype(object) * self.n - np.array(self.sums, object)
        return (d / self.n).astype(np.float64), d


def _squares(d: np.ndarray) -> list[int]:
    """Exact sums of the squares in each row."""
    if d.dtype != object and d.size and float(np.abs(d).max()) ** 2 * d.shape[1] >= 2.0**62:
        d = d.astype(object)
    return (d * d).sum(1).tolist()


def fit_list(vectors: DataFrame) -> DataFrame:
    """(d, kind, block): the distinct integer vectors of vectors (embedding), packed by length and type."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, part, x in _by_length(b, "embedding"):
                kinds, values = zip(*(_packed(v) for v in integers(x)))
                yield pa.RecordBatch.from_arrays([pa.array([d] * part.num_rows, pa.int32()), pa.array(kinds), pa.array([v.tobytes() for v in values], pa.binary())], ["d", "kind", "x"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], list[bytes]] = {}

        def block(key: tuple[int, str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]]), pa.array([b"".join(held.pop(key))], pa.binary())], ["d", "kind", "block"])

        for b in batches:
            for d, kind, x in zip(*(c.to_pylist() for c in b.columns)):
                part = held.setdefault((d, kind), [])
                part.append(x)
                if len(part) == PACK:
                    yield block((d, kind))
        for key in list(held):
            yield block(key)

    exact = vectors.select("embedding").mapInArrow(encode, "d int, kind string, x binary").distinct()
    return staged(exact.mapInArrow(pack, "d int, kind string, block binary"), "whitening-fit")


def _by_length(b: pa.RecordBatch, name: str) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """The rows of b with vectors of each length but 0, and these vectors."""
    size = pc.list_value_length(b.column(name)).to_numpy(zero_copy_only=False)
    for d in np.unique(size[size > 0]):
        part = b if (size == d).all() else b.filter(pa.array(size == d))
        yield int(d), part, matrix(part.column(name), int(d))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for b in batches:
        for d, kind, block in zip(*(c.to_pylist() for c in b.columns)):
            yield d, np.frombuffer(block, kind).reshape(-1, d).astype(np.int64)


def _summed(blocks: DataFrame, part: Callable[[int, np.ndarray], np.ndarray], width: int) -> dict[int, np.ndarray]:
    """The sum of part(d, x) over all blocks, a matrix of `width` columns for each length d.

    Each task sends its own sum row by row; Spark adds the tasks' rows up."""
    cols = [f"v{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for d, x in _blocks(batches):
            got = part(d, x)
            total[d] = total[d] + got if d in total else got
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), d, np.int32)), pa.array(np.arange(len(m), dtype=np.int32)), *(pa.array(m[:, j].copy()) for j in range(width))], ["d", "i", *cols])

    sums = blocks.mapInArrow(run, "d int, i int, " + ", ".join(f"{c} double" for c in cols)).groupBy("d", "i").agg(*[F.sum(c).alias(c) for c in cols])
    out: dict[int, list[tuple]] = {}
    for r in sums.collect():  # as many rows as a vector has components
        out.setdefault(r[0], []).append(tuple(r)[1:])
    return {d: np.array(sorted(rows))[:, 1:] for d, rows in out.items()}


def _counted(blocks: DataFrame) -> dict[int, Fit]:
    """Count and exact sums of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for d, x in _blocks(batches):
            small = int(np.abs(x).max()) < 1 << 40
            n, s = total.get(d, (0, np.zeros(d, object)))
            total[d] = n + len(x), s + (x.sum(0) if small else x.astype(object).sum(0)).astype(object)
        for d, (n, s) in total.items():
            cols = [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(int(v)) for v in s], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(cols, ["d", "i", "n", "s"])

    got = blocks.mapInArrow(run, "d int, i int, n long, s decimal(38,0)").groupBy("d", "i").agg(F.sum("n"), F.sum("s")).orderBy("d", "i").collect()
    fits: dict[int, Fit] = {}
    for d, _, n, s in got:
        fits.setdefault(d, Fit(n, [])).sums.append(int(s))
    return fits


class Lanczos:
    """The largest eigenpairs of a symmetric map of d dimensions that the caller applies:
    multiply self.block, give the product to take(), until done."""

    def __init__(self, d: int, want: int, width: int = WIDTH, basis: int = BASIS, seed: int = 1):
        self.d, self.want, self.width = d, min(want, d), min(max(width, want), d)
        self.most = max(3, basis) * self.width
        self.rng = np.random.default_rng(seed)
        self.q, self.aq = np.zeros((d, 0)), np.zeros((d, 0))
        self.block = self._new(np.zeros((d, 0)), self.width)
        self.done, self.breakdowns = False, 0

    def _new(self, found: np.ndarray, k: int) -> np.ndarray:
        """k random directions orthogonal to the basis and to those found."""
        while found.shape[1] < k:
            v = self.rng.standard_normal(self.d)
            for _ in range(3):
                v = v - self.q @ (self.q.T @ v)
                v = v - found @ (found.T @ v)
                v = v / np.linalg.norm(v)
            found = np.column_stack([found, v])
        return found

    def take(self, product: np.ndarray) -> None:
        self.q, self.aq = np.column_stack([self.q, self.block]), np.column_stack([self.aq, product])
        h = self.q.T @ self.aq
        e, s = np.linalg.eigh((h + h.T) / 2)
        e, s = e[::-1], s[:, ::-1]
        y = self.q @ s[:, : self.want]
        residual = np.linalg.norm(self.aq @ s[:, : self.want] - y * e[: self.want], axis=0)
        top = max(float(np.abs(e).max()), 0.0)
        if self.q.shape[1] == self.d or self.q.shape[1] >= self.want and residual.max() <= TOLERANCE * top:
            self.values, self.vectors, self.done = e[: self.want], y, True
            return
        w = product
        for _ in range(2):
            w = w - self.q @ (self.q.T @ w)
        if self.q.shape[1] + self.width > self.most:
            keep = s[:, : 2 * self.width]
            # Directions of the next block stay orthogonal to the part of the basis that goes.
            self.q, self.aq = self.q @ keep, self.aq @ keep
        found, k = np.zeros((self.d, 0)), min(self.width, self.d - self.q.shape[1])
        for v in w.T:
            if found.shape[1] == k:
                break
            for _ in range(2):
                v = v - self.q @ (self.q.T @ v)
                v = v - found @ (found.T @ v)
            size = np.linalg.norm(v)
            if size > 1e-14 * top:
                v = v / size
                v = v - self.q @ (self.q.T @ v)
                v = v - found @ (found.T @ v)
                found = np.column_stack([found, v / np.linalg.norm(v)])
        self.breakdowns += found.shape[1] < k
        self.block = self._new(found, k)


def fit(blocks: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The model of each length of vector: components by falling eigenvalue, trace, and
    how far the whitened fit list's covariance is from the identity."""
    fits = _counted(blocks)

    def product(v: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        shared = blocks.sparkSession.sparkContext.broadcast({d: (fits[d], m) for d, m in v.items()})  # a few columns

        def part(d: int, x: np.ndarray) -> np.ndarray:
            if d not in shared.value:
                return np.zeros((0, WIDTH))
            f, m = shared.value[d]
            c = f.deviations(x)[0]
            return np.pad(c.T @ (c @ m) / f.n, ((0, 0), (0, width - m.shape[1])))

        width = max(m.shape[1] for m in v.values())
        found = _summed(blocks, part, width)
        return {d: found[d][:, : m.shape[1]] for d, m in v.items()}

    solvers = {d: Lanczos(d, components, max(WIDTH, components)) for d in fits}
    for _ in range(PASSES):
        todo = {d: s for d, s in solvers.items() if not s.done}
        if not todo:
            break
        for d, av in product({d: s.block for d, s in todo.items()}).items():
            todo[d].take(av)
    else:
        raise RuntimeError(f"no convergence in {PASSES} passes")
    for d, s in solvers.items():
        keep = s.values > LEAST * max(float(s.values[0]), 0.0)
        fits[d].values, y = s.values[keep], s.vectors[:, keep]
        sign = np.sign(y[np.abs(y).argmax(0), np.arange(y.shape[1])])
        fits[d].vectors = y * np.where(sign == 0, 1, sign)
    if fits:
        _check(blocks, fits, components)
    return fits


def _check(blocks: DataFrame, fits: dict[int, Fit], components: int) -> None:
    """Sets trace and error of fits: one more pass."""
    shared = blocks.sparkSession.sparkContext.broadcast(fits)

    def part(d: int, x: np.ndarray) -> np.ndarray:
        f = shared.value[d]
        c, exact = f.deviations(x)
        w = np.pad(c @ f.vectors / np.sqrt(f.values), ((0, 0), (0, components - len(f.values))))
        share = sum(float(v) for v in _squares(exact)) / float(f.n) ** 3
        return np.vstack([w.T @ w / f.n, w.mean(0) * (len(x) / f.n), np.full(components, share)])

    for d, m in _summed(blocks, part, components).items():
        f, k = fits[d], len(fits[d].values)
        cov = m[:k, :k] - np.outer(m[components, :k], m[components, :k])
        f.trace, f.error = float(m[-1, 0]), float(np.abs(cov - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row of
    vectors (vec_id, embedding) and component.

    Rows whose vector is null or holds a null or non-finite entry are left out; zero
    vectors stay. Repeated rows count once in the fit and each have their result; so do
    rows that share or lack a vec_id. deviation is a decimal, null beyond 38 digits. A
    component whose eigenvalue is zero to rounding can't be whitened and isn't returned:
    none for a single vector, or for vectors without entries; of d entries there are at
    most d. Each length of vectors has a fit of its own. Other columns are ignored."""
    rows = vectors.where(finite()).select("vec_id", "embedding")
    shared = vectors.sparkSession.sparkContext.broadcast(fit(fit_list(rows), components))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, part, x in _by_length(b, "embedding"):
                f = shared.value[d]
                c, exact = f.deviations(integers(x))
                w, k, m = c @ f.vectors / np.sqrt(f.values), len(f.values), part.num_rows
                deviation = pa.array([Decimal(v) if v < 10**38 else None for v in _squares(exact)], pa.decimal128(38, 0))
                at = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, f.n)), deviation.take(at),
                     pa.array(w.ravel()), pa.array(np.tile(f.values / f.trace, m)), pa.array(np.full(m * k, f.error))],
                    [x.name for x in schema],
                )

    schema = T.StructType(
        [T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.DecimalType(38, 0)),
         T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())]
    )
    return rows.mapInArrow(run, schema)
