"""SimHash near-duplicates and connected components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from riffle.llm import simhash_vptree as S
from riffle.llm.common import connected_components
from riffle.llm.disjoint import Disjoint


def _plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for ch in "\t\n\x0b\x0c\r":
        words = words.replace(ch, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _components(nodes, linked):
    lead = {n: n for n in nodes}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        lead[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", ["", None, "one", "one two", "A b\tC\x0bd e f", "Ünï ÀB x y z", "a a a a a a"])
def test_fingerprint(text):
    assert S.simhash((text or "").encode()) == _plain(text)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("of the x",)], "s string").select(F.xxhash64("s").alias("h")).first()["h"]
    assert got & (2**64 - 1) == xxhash.xxh64_intdigest(b"of the x", 42)


@pytest.mark.parametrize("seed", range(4))
def test_trees_lose_no_pair(seed, monkeypatch):
    monkeypatch.setattr(S, "_BRUTE", 400)
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = np.concatenate([base[:150] ^ (np.uint64(1) << np.uint64(rng.integers(0, 64))) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) for _ in range(4)])
    fp = np.unique(np.concatenate([base, near]))
    want = {(i, j) for i in range(len(fp)) for j in range(i) if bin(int(fp[i] ^ fp[j])).count("1") <= 3}
    found = Disjoint(len(fp))
    for k, x in enumerate(S._halves(fp)):
        tree = S.build_tree(x[::3], 16)
        home = np.empty(len(fp), np.int64)
        home.put(*S.route(tree, x, 0))
        row, leaf = S.route(tree, x, 1)
        for shard in np.unique(leaf):
            rows = row[leaf == shard]
            own = Disjoint(len(rows))
            S._search(fp[rows], home[rows] == shard, S._halves(fp[rows])[k], 1, own)
            found.union(rows, rows[own.roots()])
    assert dict(enumerate(found.roots())) == _components(range(len(fp)), want)


def test_near_duplicates_against_brute_force(docs_of):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(500)]
    rows, at = [], 0
    for _ in range(25):
        words = rng.choices(vocab, k=rng.randint(60, 200))
        for _ in range(rng.randint(1, 4)):
            w = list(words)
            if rng.random() < 0.7:
                w[rng.randrange(len(w))] = "changed"
            rows.append((at * 3 + 5, " ".join(w)))
            at += 1
    rows += [(900, None), (901, ""), (902, " \n"), (903, "x"), (903, "x"), (None, "x"), (904, "long " * 30_000)]
    fps = [(d, _plain(t)) for d, t in rows]
    linked = [(a, b) for a, x in fps for b, y in fps if a is not None and b is not None and bin(x ^ y).count("1") <= 3]
    want = _components({d for d, _ in fps if d is not None}, linked)
    got = S.near_duplicates(docs_of(rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert sorted((r.doc_id or -1, r.fp & (2**64 - 1)) for r in got) == sorted((d or -1, f) for d, f in fps)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    kept = S.drop_near_duplicates(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x)) == sorted(set(want.values())) + [None]


def test_a_doc_id_with_two_texts_ties_their_groups(docs_of):
    rows = [(1, "a b c d"), (1, "e f g h"), (2, "a b c d"), (3, "e f g h")]
    assert {r.component_id for r in S.near_duplicates(docs_of(rows)).collect()} == {1}


def test_empty_table(docs_of):
    assert S.near_duplicates(docs_of([])).count() == 0
    assert S.drop_near_duplicates(docs_of([])).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    edges = {
        "chain": [(i, i + 1) for i in range(200)], "star": [(500, i) for i in range(300)] + [(i, 700) for i in range(3)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], "none": [],
    }[shape]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pd.DataFrame(edges, columns=["a", "b"], dtype="int64"), "a long, b long") if edges else spark.createDataFrame([], "a long, b long")).collect()}
    want = _components({x for e in edges for x in e if e[0] != e[1]}, edges)
    assert got == want
