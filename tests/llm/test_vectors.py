"""Vector operators against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riffle.llm import ann_permutation, embedding_ego

BAD = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, []]


def _table(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, component_id int")


def _vectors(n, seed=0, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(n // 3):  # near copies, some of them chains
        x[n - 1 - i] = x[i % 20] + 0.08 * rng.standard_normal(dim)
    return x.astype(np.float32)


def _usable(v):
    return v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)


def _plain_links(rows, least):
    n = len(rows)
    ok = [bool(_usable(v)) for _, v, _ in rows]
    links, lead = [0] * n, list(range(n))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                    links[i] += 1
                    links[j] += 1
                    lead[max(find(i), find(j))] = min(find(i), find(j))
    roots = [find(i) for i in range(n)]
    least_id = {}
    for i, r in enumerate(roots):
        if rows[i][0] is not None:
            least_id[r] = min(least_id.get(r, rows[i][0]), rows[i][0])
    return [(rows[i][0], links[i], least_id.get(roots[i])) for i in range(n)]


def test_ego_join_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_ego, "BLOCK", 40)
    monkeypatch.setattr(embedding_ego, "LEAF", 8)
    x = _vectors(260)
    rows = [(900 - i, v.tolist(), None if i % 40 == 7 else int(i % 20) % 2) for i, v in enumerate(x)]
    rows += [(2000 + i, v, 0) for i, v in enumerate(BAD)] + [(900, rows[0][1], 0), (None, rows[0][1], 0), (3000, [1.0, 2.0], 0), (3001, [1.0, 2.1], 0)]
    rows += [(4000 + i, rows[5][1], rows[5][2]) for i in range(60)]
    got = embedding_ego.near_duplicates(_table(spark, rows), 0.93).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == sorted(_plain_links(rows, 0.93), key=str)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_ego_join_of_nothing(spark):
    assert embedding_ego.near_duplicates(_table(spark, [])).count() == 0
    only = embedding_ego.near_duplicates(_table(spark, [(1, None, 0), (2, [1.0], None)])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in only) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_search_of_all_is_exact(spark):
    x = _vectors(300, 1)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000 + 50 * i, v, 0) for i, v in enumerate(BAD)] + [(5000, [1.0, 2.0], 0), (7, x[7].tolist(), 0), (None, x[0].tolist(), 0), (301, x[50].tolist(), 0), (302, x[50].tolist(), 0)]
    got = ann_permutation.search(_table(spark, rows), F.col("vec_id") % 50 == 0, 5, share=1.0).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids = np.array([*range(300), 301, 302])
    y = np.concatenate([x, x[[50, 50]]]).astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    for q in range(0, 300, 50):
        s = y @ y[q]
        want = sorted((-round(float(s[i]), 9), int(ids[i])) for i in range(len(ids)) if ids[i] != q)[:5]
        have = sorted(found[q])
        assert [v for _, v, _ in have] == [i for _, i in want]
        assert [c for *_, c in have] == pytest.approx([-a for a, _ in want])
    assert 5000 not in found and set(found) == set(range(0, 300, 50))


def test_recall_on_isotropic_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann_permutation, "LEAST", 32)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 64)).astype(np.float32)
    got = ann_permutation.search(_table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), F.col("vec_id") % 100 == 0, 5).collect()
    y = x.astype(float) / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q in range(0, 4000, 100):
        s = y @ y[q]
        s[q] = -9
        hit += len(set(np.argsort(-s)[:5].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hit / 200 >= 0.9


def test_search_of_nothing(spark):
    assert ann_permutation.search(_table(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert ann_permutation.search(_table(spark, [(0, [1.0, 2.0], 0)]), F.col("vec_id") % 50 == 0).count() == 0
