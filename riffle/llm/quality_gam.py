"""Quality classifier: a generalised additive model with pairwise interactions.

The score is a sigmoid of a sum of lookup tables, one for each feature's bins and one
for the bins of each chosen pair of features. Shallow trees fit to the gradient's
histograms are added to the tables in turn, feature by feature, with a small step;
then the pairs whose grids still explain most are boosted the same way. Features come
from one pass over the whole texts; scoring is a vectorised addition of table entries.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations, groupby
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Labelled doc_ids, and distinct rows of them, to fit on, at most about; those with the least hashes.
FIT_ROWS = 50_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 60, 6
STEP, RIDGE = 0.15, 2.0
ACCEPT = 0.7

FEATURES = (
    "log_words", "upper", "symbols", "bangs", "bars", "digits", "periods", "non_ascii", "mean_word",
    "distinct", "same_next", "top_word", "longest_run", "same_line", "mean_line", "marked_words",
)
_SYMBOLS = np.frombuffer(b"%*&$#~^<>{}[]\\=+@_", np.uint8)
_MARKED = frozenset(b"%*&$#!|")


def features(text: str) -> list[float]:
    """Features of a text, in the order of FEATURES; all 0 for a text without words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, letters = int(of[65:91].sum()), int(of[65:91].sum() + of[97:123].sum())
    lines = [x for x in raw.split(b"\n") if x]
    same = sum(map(eq, words, words[1:]))
    return [
        math.log1p(n),
        upper / max(letters, 1),
        float(of[_SYMBOLS].sum()) / size,
        float(of[33]) / n,
        float(of[124]) / n,
        float(of[48:58].sum()) / size,
        float(of[46]) / n,
        float(of[128:].sum()) / size,
        (size - n) / n,
        len(set(words)) / n**0.8,
        same / n,
        max(Counter(words).values()) / n,
        math.log(max(sum(1 for _ in g) for _, g in groupby(words))) if same else 0.0,
        1 - len(set(lines)) / max(len(lines), 1),
        math.log1p(n / max(len(lines), 1)),
        sum(w[-1] in _MARKED for w in words) / n,
    ]


def featurise(docs: DataFrame) -> DataFrame:
    """(doc_id, f array<double>); a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.list_(pa.float64()))], ["doc_id", "f"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, f array<double>")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Values by bin of a shallow tree over ordered bins with gradient sums g and weights h."""
    parts, values = [(0, len(g))], np.zeros(len(g))
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            lg, lh, tg, th = cg[:-1], ch[:-1], cg[-1], ch[-1]
            gain = lg**2 / (lh + RIDGE) + (tg - lg) ** 2 / (th - lh + RIDGE) - tg**2 / (th + RIDGE)
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (float(gain[at]), k, a + at + 1)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    for a, b in parts:
        values[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return values


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of the tree that cuts a grid once by each axis, and its gain."""
    cg, ch = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))
    best = (0.0, None)
    n, m = g.shape
    for i in range(1, n):
        for j in range(1, m):
            gain, out = 0.0, []
            for a, b, c, d in ((0, i, 0, j), (0, i, j, m), (i, n, 0, j), (i, n, j, m)):
                sg = cg[b, d] - cg[a, d] - cg[b, c] + cg[a, c]
                sh = ch[b, d] - ch[a, d] - ch[b, c] + ch[a, c]
                gain += sg * sg / (sh + RIDGE)
                out.append((a, b, c, d, sg / (sh + RIDGE)))
            if gain > best[0]:
                best = (gain, out)
    values = np.zeros_like(g)
    for a, b, c, d, v in best[1] or ():
        values[a:b, c:d] = v
    return values, best[0]


@dataclass
class Model:
    """Cuts of each feature's bins, its table, and the tables of pairs on coarser bins."""

    bias: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total = np.full(len(x), self.bias)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cut, x[:, j], "right")]
        grid = {j: np.searchsorted(self.coarse[j], x[:, j], "right") for p in self.pairs for j in p[:2]}
        for i, j, table in self.pairs:
            total += table[grid[i], grid[j]]
        return _sigmoid(total)


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Model:
    """Fit to features x and labels y of 0 and 1, of weighted rows. Without rows every score is 0.5."""
    weight = np.ones(len(y)) if weight is None else weight
    pos = float(weight @ y)
    model = Model(bias=math.log((pos + 1) / (float(weight.sum()) - pos + 1)))
    if not len(y) or y.min() == y.max():
        return model
    model.cuts = [_cuts(c, BINS) for c in x.T]
    model.coarse = [_cuts(c, PAIR_BINS) for c in x.T]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    fine = [np.searchsorted(c, v, "right") for c, v in zip(model.cuts, x.T)]
    coarse = [np.searchsorted(c, v, "right") for c, v in zip(model.coarse, x.T)]
    total = np.full(len(y), model.bias)
    for _ in range(ROUNDS):
        for j, b in enumerate(fine):
            p = _sigmoid(total)
            n = len(model.tables[j])
            add = STEP * _tree(np.bincount(b, weight * (y - p), n), np.bincount(b, weight * p * (1 - p), n))
            model.tables[j] += add
            total += add[b]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, shape = _sigmoid(total), (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        cell, size = coarse[i] * shape[1] + coarse[j], shape[0] * shape[1]
        return np.bincount(cell, weight * (y - p), size).reshape(shape), np.bincount(cell, weight * p * (1 - p), size).reshape(shape), cell

    gains = sorted(((_quadrants(*grids(i, j)[:2])[1], i, j) for i, j in combinations(range(x.shape[1]), 2)), key=lambda g: (-g[0], g[1:]))
    chosen = {(i, j): np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for gain, i, j in gains[:PAIRS] if gain > 0}
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in chosen.items():
            g, h, cell = grids(i, j)
            add = STEP * _quadrants(g, h)[0]
            table += add
            total += add.ravel()[cell]
    model.pairs = [(i, j, t) for (i, j), t in chosen.items()]
    return model


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on the rows of docs (doc_id, text) with a label (doc_id, quality).

    Beyond about fit_rows labelled doc_ids, those with the least hashes are taken; ids and
    labels meet before any text is read. Equal rows are one row with a weight, so that the
    driver gets about fit_rows rows, however often one is repeated."""
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    least = lambda hashed, n: F.pmod(hashed, F.lit(1 << 24)) < int(min(1.0, fit_rows / max(n, 1)) * (1 << 24))
    met = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id").distinct()
    chosen = staged(met.where(least(F.xxhash64("doc_id"), met.count())), "quality-ids")
    part = featurise(docs.join(F.broadcast(chosen), "doc_id", "left_semi")).groupBy("doc_id", "f").count()
    rows = staged(part.join(known.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id", "quality").count().withColumnRenamed("count", "times"), "doc_id"), "quality-rows")
    rows = rows.where(least(F.xxhash64("doc_id", "f"), rows.count())).select("doc_id", "quality", "f", (F.col("count") * F.col("times")).alias("weight"))
    got = sorted((r.doc_id, r.quality, tuple(r.f), r.weight) for r in rows.collect())
    x = np.array([r[2] for r in got], np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[1] for r in got], np.float64), np.array([r[3] for r in got], np.float64))


def classify(docs: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Rows whose remainder(folds) is held_out teach the model nothing. Null and empty texts
    get the score of a text without words; a row without doc_id is scored, is not held
    out and has no label. Repeated rows repeat their score, and count as often as they
    stand in either table; labels other than 0 and 1 are ignored; without labels every
    score is 0.5. Only the text is an input.
    """
    out = F.coalesce(remainder(folds) == held_out, F.lit(False))
    model = learn(docs.where(~out), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(model, b.column(1)))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    return model.score(np.array([features(t.as_py() or "") for t in texts], np.float64).reshape(-1, len(FEATURES)))


def keep_good(docs: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4, accept: float = ACCEPT) -> DataFrame:
    """docs, all columns, without the rows that classify() would score below accept.

    The fitted model travels with the tasks, so the texts are filtered where they are
    read and never joined or shuffled.
    """
    out = F.coalesce(remainder(folds) == held_out, F.lit(False))
    model = learn(docs.where(~out), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scores(model, b.column("text")) >= accept))

    return docs.mapInArrow(run, docs.schema)
