"""Whitening against the whole covariance and its eigenvectors."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from riffle.llm import whitening


def _table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, label int, whitened double")


def _vectors(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, dim)) * np.linspace(1.5, 0.5, dim)).astype(np.float32)


def _plain(x, components):
    fit = np.array(sorted({tuple(int(math.floor(256.0 * float(c))) for c in v) for v in x}), np.int64)
    n, s = len(fit), [int(v) for v in fit.sum(0)]
    c = np.array([[float(Fraction(n * int(a) - t, n)) for a, t in zip(v, s)] for v in fit])
    cov = c.T @ c / n
    e, y = np.linalg.eigh(cov)
    return n, s, e[::-1][:components], y[:, ::-1][:, :components], np.trace(cov)


@pytest.mark.parametrize("dim,most", [(16, 12), (64, 12), (120, 3)])
def test_against_the_whole_covariance(spark, monkeypatch, dim, most):
    monkeypatch.setattr(whitening, "PACK", 50)
    monkeypatch.setattr(whitening, "BASIS", most)
    x = _vectors(500, dim)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (None, x[3].tolist()), (900, [0.0] * dim)]
    bad = [(1000, None), (1001, [None] + [1.0] * (dim - 1)), (1002, [math.nan] * dim), (1003, [math.inf] * dim), (1004, [])]
    got = whitening.whiten(_table(spark, rows + bad)).collect()
    assert len(got) == 4 * len(rows)
    n, s, e, y, trace = _plain([v for _, v in rows], 4)
    by_id = {}
    for r in got:
        by_id.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for i, v in rows:
        ints = [math.floor(256.0 * c) for c in v]
        for k in range(4):
            r = by_id[i, k + 1][0]
            assert (r.n, int(r.deviation)) == (n, sum((n * a - t) ** 2 for a, t in zip(ints, s)))
            want = sum((a - t / n) * w for a, t, w in zip(ints, s, y[:, k])) / math.sqrt(e[k])
            sign = signs.setdefault(k, 1.0 if r.whitened * want > 0 else -1.0)
            assert r.whitened == pytest.approx(sign * want, abs=1e-9)
            assert r.explained == pytest.approx(e[k] / trace, rel=1e-9) and r.identity_error < 1e-9
    assert len(by_id[7, 1]) == 2 and len(by_id[None, 1]) == 1


def test_breakdown_restarts():
    """A map of rank 3, whose second block breaks down, and one with an eigenspace of 20 dimensions, whose basis closes."""
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((60, 60)))
    for e, broken in (([9.0, 4.0, 1.0] + [0.0] * 57, True), ([5.0] * 20 + [1.0] * 40, False)):
        a = q @ np.diag(e) @ q.T
        s = whitening.Lanczos(60, 4)
        for _ in range(100):
            s.take(a @ s.block)
            if s.done:
                break
        assert s.done and bool(s.breakdowns) == broken
        assert s.values == pytest.approx(sorted(e)[::-1][:4], abs=1e-12)
        assert np.abs(a @ s.vectors - s.vectors * s.values).max() < 1e-11
        assert np.abs(s.vectors.T @ s.vectors - np.eye(4)).max() < 1e-12


def test_restarted_basis_stays_small():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((300, 300)))
    a = q @ np.diag(1 / np.arange(1.0, 301)) @ q.T
    s, most = whitening.Lanczos(300, 4, basis=4), 0
    for _ in range(300):
        s.take(a @ s.block)
        most = max(most, s.q.shape[1])
        if s.done:
            break
    assert s.done and most <= 32
    assert s.values == pytest.approx([1, 1 / 2, 1 / 3, 1 / 4], rel=1e-12)
    assert np.abs(np.abs((q[:, :4] * s.vectors).sum(0)) - 1).max() < 1e-12


def test_few_distinct_vectors_and_lengths(spark):
    a, b = [1.0, 2.0, 3.0], [1.5, 2.0, -1.0]
    got = whitening.whiten(_table(spark, [(1, a), (2, b), (3, a), (4, [1.0]), (5, [2.0]), (6, [7.0, 7.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in got) == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 1, 2), (5, 1, 2)]
    assert all(abs(r.whitened) == pytest.approx(1.0) and r.explained == pytest.approx(1.0) for r in got)
    assert whitening.whiten(_table(spark, [])).count() == 0
    assert whitening.whiten(_table(spark, [(1, a), (2, a)])).count() == 0


def test_large_numbers_stay_exact(spark):
    x = [[2.0**30 * i, -1.0] for i in (1, 2, 4)] + [[1e30, 0.0]]
    ints = [[int(v) for v in whitening.integers(np.array(r))] for r in x]
    assert ints[0] == [2**38, -256] and ints[3][0] == 2**63 - 1
    s = [sum(c) for c in zip(*ints)]
    got = {r.vec_id: r for r in whitening.whiten(_table(spark, list(enumerate(x)))).collect() if r.component == 1}
    for i, v in enumerate(ints):
        want = sum((4 * a - t) ** 2 for a, t in zip(v, s))
        assert got[i].deviation is None if want >= 10**38 else int(got[i].deviation) == want
