"""Source mixing and sharding against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from riffle.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _hash(doc_id, text):
    name = str(doc_id) if doc_id is not None else "text:" + hashlib.md5((text or "").encode()).hexdigest()
    return int(hashlib.md5(name.encode()).hexdigest()[:15], 16)


def _targets(size):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full: set = set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        target = {s: 3.0 * size[s] if s in full else weight[s] * left / w for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * size[s]}
        if not over:
            return target
        full |= over


def _plain_mix(rows):
    size = Counter({s: 0 for *_, s in rows})
    for d, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    target, out = _targets(size), []
    by = defaultdict(list)
    for d, t, s in rows:
        by[s].append((_hash(d, t), len(WORD.findall(t or "")), d))
    for s, docs in by.items():
        whole = min(3, int(target[s] // size[s])) if size[s] else 0
        rest, total, cut = target[s] - whole * size[s], 0, -1
        tokens = Counter()
        for h, n, _ in docs:
            tokens[h] += n
        for h in sorted(tokens) if rest > 0 else ():
            if total + tokens[h] >= rest:
                cut = h if total + tokens[h] - rest < rest - total else h - 1
                break
            total += tokens[h]
        out += [(d, n, size[s], round(target[s], 6), n * (whole + (h <= cut))) for h, n, d in docs]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, docs_of, seed):
    import random

    rng = random.Random(seed)
    big = [(i, "w " * rng.randint(0, 60), "hot") for i in range(3000)]
    rows = big + [(10_000 + i, "a b\tc " * rng.randint(1, 9), rng.choice(["a", "b", "é", None, "z"])) for i in range(80)]
    rows += [(20_000, None, "n"), (20_001, "", "n"), (None, "null id", "a"), (7, "again again", "hot"), (7, "again again", "hot"), (30_000, "x " * 50_000, "b")]
    got = mixing.mix(docs_of(rows)).collect()
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == _plain_mix(rows)
    taken = Counter()
    for r in mixing.resample(docs_of(rows)).select("doc_id", "text").collect():
        taken[r.doc_id, r.text] += 1
    want = Counter()
    for d, t, s in rows:
        c = next(r.copies for r in got if r.doc_id == d and r.source == s and r.size == len(WORD.findall(t or "")))
        want[d, t] += c
    assert {k: v for k, v in want.items() if v} == dict(taken)
    assert mixing.resample(docs_of(rows)).columns == docs_of(rows).columns


def test_mix_of_nothing(docs_of):
    assert mixing.mix(docs_of([])).count() == 0
    assert mixing.resample(docs_of([])).count() == 0
    assert [(r.target, r.taken) for r in mixing.mix(docs_of([(1, None), (2, "")])).collect()] == [(0.0, 0)] * 2


def _feistel(x, a, b):
    left, right = divmod(x, b)

    def f(v, k):
        m, c = sharding.ROUND_KEYS[k]
        y = (v * m + c) % sharding.PRIMES[0]
        return y * y % sharding.PRIMES[1] + y

    for k in range(4):
        if k % 2 == 0:
            left = (left + f(right, k)) % a
        else:
            right = (right + f(left, k)) % b
    return left * b + right


@pytest.mark.parametrize("walk", [16, 1])
@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 100, 1001])
def test_permutation(spark, n, walk, monkeypatch):
    """With a first walk of one step the longer loop ends the rest."""
    import math

    monkeypatch.setattr(sharding, "WALK", walk)
    got = [r.p for r in spark.range(n).coalesce(1).select(sharding.permute(F.col("id"), n).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    b = math.isqrt(max(n - 1, 0)) + 1
    a = -(-n // b)
    for i, p in enumerate(got):
        x = _feistel(i, a, b)
        while x >= n:
            x = _feistel(x, a, b)
        assert x == p


def test_equal_rows_are_dealt_on(docs_of, monkeypatch):
    """Many rows equal in all columns fill several ranges and have slots of their own."""
    monkeypatch.setattr(sharding, "RANGE", 500)
    ranges = []
    window = sharding.staged
    monkeypatch.setattr(sharding, "staged", lambda df, name: ranges.append(window(df, name)) or ranges[-1])
    got = sharding.shard(docs_of([(None, None)] * 4000 + [(i, "x") for i in range(100)]).repartition(2)).collect()
    assert sorted((r.shard, r.slot) for r in got) == sorted((p % 16, p // 16) for p in range(4100))
    sizes = [r["count"] for r in next(r for r in ranges if "_part" in r.columns and "doc_id" in r.columns).groupBy("_part").count().collect()]
    assert max(sizes) < 1500


def test_shards(docs_of, monkeypatch):
    rows = [(i % 400, f"text {i % 300} é" * (i % 3)) for i in range(1500)] + [(None, None), (None, ""), (5, "long " * 40_000)]
    first = sharding.shard(docs_of(rows)).collect()
    monkeypatch.setattr(sharding, "RANGE", 100)
    again = sharding.shard(docs_of(rows[::-1]).repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, first)) == sorted(map(key, again))
    want = Counter((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter(key(r)[:3] for r in first) == want
    by = defaultdict(list)
    for r in first:
        by[r.shard].append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard(docs_of([])).count() == 0
