"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from test_dedup import _components

import corpus_pipeline
from riffle.llm import near_copies as N


def _set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def _near(x, y):
    return 10 * len(x & y) >= 8 * len(x | y)


def _rows():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(800)]
    passage = rng.choices(vocab, k=60)
    rows = []
    for _ in range(60):
        words = rng.choices(vocab, k=rng.randint(20, 200))
        if rng.random() < 0.4:
            words = passage + words[:30]
        for _ in range(rng.randint(1, 5)):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows) * 3 + 5, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_link_loses_no_pair(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 400, rng.integers(1, 80))
        for _ in range(6):
            sets.append(np.unique(np.where(rng.random(len(base)) < rng.choice([0, 0.08, 0.2]), rng.integers(0, 400, len(base)), base)).astype(np.uint64))
    plain = [set(s.tolist()) for s in sets]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if _near(plain[i], plain[j])]
    assert dict(enumerate(N.link(sets).roots())) == _components(range(len(sets)), linked)


@pytest.mark.parametrize("group", [512, 3])
def test_stage_against_brute_force(spark, docs_of, monkeypatch, group):
    monkeypatch.setattr(N, "GROUP", group)
    rows = _rows()
    sets = [(d, _set(t)) for d, t in rows]
    far = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if _near(x, y) and x != y]
    assert len(far) > 20
    want = _components([d for d, _ in rows], [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if _near(x, y)])
    extra = [(9000, None), (9001, ""), (9002, "a b"), (9003, "A  b"), (9003, "b a"), (9004, "b a"), (None, "a b")]
    stage = dict(corpus_pipeline.STAGES)["near_copies"]
    docs = docs_of(rows + extra)
    got = stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=lambda x: (x is None, x)) == sorted({*want.values(), 9000, 9002}) + [None]
    found = {r.doc_id: r.component_id for r in N.near_copies(docs_of(rows)).collect()}
    assert found == want


def test_empty_table(docs_of):
    assert N.drop_near_copies(docs_of([])).count() == 0


def test_simhash_is_a_majority_of_the_shingles():
    def drawn(h, k):  # SplitMix64
        x = (h + (k + 1) * 0x9E3779B97F4A7C15) % 2**64
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    for n in (1, 2, 5, 300):
        h = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)
        want = [int(2 * sum(drawn(int(x), i // 64) >> i % 64 & 1 for x in h) > n) for i in range(200)]
        assert N.simhash_bits(h, 200).tolist() == want


def test_trees_are_enough_for_all_sizes():
    def sums(n):
        return [math.comb(n, i) / 2**n for i in range(n + 1)]

    def differ(c, a, b):
        out = 0.0
        for i, p in enumerate(sums(c)):
            x = sum(w for j, w in enumerate(sums(a)) if 2 * (i + j) > c + a)
            y = sum(w for j, w in enumerate(sums(b)) if 2 * (i + j) > c + b)
            out += p * (x * (1 - y) + y * (1 - x))
        return out

    assert differ(4, 1, 0) == N.P_LEAST
    for c in range(5, 90):
        for more in {1, c // 4}:
            assert max(differ(c, a, more - a) for a in range(more + 1)) <= N.P
    for n in (0, 1000, 10**6, 10**8):
        bits, trees, trees_least = N.forest(n)
        for p, many in (N.P, trees), (N.P_LEAST, trees_least):
            assert (1 - (1 - p) ** bits - bits * p * (1 - p) ** (bits - 1)) ** many <= N.MISS
    off = lambda p, most: sum(math.comb(N.CHECK, i) * p**i * (1 - p) ** (N.CHECK - i) for i in range(most + 1, N.CHECK + 1))
    assert off(N.P, N.MAX_OFF) < 2e-7 and off(N.P_LEAST, N.MAX_OFF_LEAST) < 2e-7


@pytest.mark.parametrize("shard", [1 << 18, 40])
def test_candidates_are_what_trees_find(spark, monkeypatch, shard):
    """Rows whose key of one tree is within a bit, of like sizes and CHECK bits: all of them, and no others."""
    monkeypatch.setattr(N, "SHARD", shard)
    rng = np.random.default_rng(5)
    trees, rows = 6, []
    for i in range(400):
        check, keys, size = rng.integers(0, 2**32, 4, dtype=np.uint32), rng.integers(0, 2**16, trees, dtype=np.uint32), int(rng.integers(20, 90))
        for _ in range(1 + i % 3):
            some = np.where(rng.random(trees) < 0.6, rng.integers(0, 2**16, trees, dtype=np.uint32), keys ^ (rng.integers(0, 2, trees) << rng.integers(0, 16, trees)).astype(np.uint32))
            rows.append((2 * len(rows) + 1, size + int(rng.integers(0, 12)), np.concatenate([check ^ np.uint32(rng.integers(0, 2**12)), some]).astype("<u4")))

    def linked(x, y):
        near = any(bin(int(a ^ b)).count("1") <= 1 for a, b in zip(x[2][4:], y[2][4:]))
        off = sum(bin(int(a ^ b)).count("1") for a, b in zip(x[2][:4], y[2][:4]))
        return near and off <= N.MAX_OFF and 5 * min(x[1], y[1]) >= 4 * max(x[1], y[1])

    want = _components([r[0] for r in rows], [(x[0], y[0]) for i, x in enumerate(rows) for y in rows[:i] if linked(x, y)])
    assert 50 < sum(k != v for k, v in want.items())
    classes = spark.createDataFrame([(r, n, s.tobytes()) for r, n, s in rows], "rep long, size long, sketch binary").repartition(3)
    edges = [(e.a, e.b) for e in N.candidates(classes).collect()]
    assert _components([r[0] for r in rows], edges) == want


def test_short_texts(docs_of):
    """Four shingles of five, five of six and eight of nine and ten are near; three of four aren't."""
    rows = []
    for i in range(40):
        for n, m in (7, 8), (8, 9), (9, 10), (12, 14):
            words = [f"x{i}-{n}-{j}" for j in range(m)]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:n]))]
    sets = [(d, _set(t)) for d, t in rows]
    want = _components([d for d, _ in rows], [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if _near(x, y)])
    assert len(set(want.values())) == 40 * 5
    assert {r.doc_id: r.component_id for r in N.near_copies(docs_of(rows)).collect()} == want
