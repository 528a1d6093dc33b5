"""The pipeline's stages, one after another, against plain versions of them."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from test_dedup import _components
from test_mix_shard import WORD, _hash, _targets
from test_near_copies import _near, _set
from test_text_ops import _plain_base

import corpus_pipeline
from riffle.llm import quality_gam, secrets, sentencepiece


def _documents():
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        words = ["".join(rng.choices("aeioutrnsl", k=rng.randint(2, 8))) for _ in range(rng.randint(30, 120))]
        bad = rng.random() < 0.3
        if bad:
            words = [w.upper() + "!!" for w in words]
        if rng.random() < 0.2:
            words.insert(3, "password=hunter2222")
        text = " ".join(words)
        rows.append((i, text, rng.choice(["a", "b", "c", None])))
        labels.append((i, int(not bad), 0))
        if rng.random() < 0.2:
            rows.append((1000 + i, text if rng.random() < 0.5 else text + " more", "a"))
    return rows, labels


def test_stages_and_run(spark, tmp_path):
    rows, labels = _documents()
    docs = pd.DataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], columns=["doc_id", "text", "lang", "source", "n_chars"])
    docs.to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).to_parquet(tmp_path / "labels.parquet")

    quality = dict((d, q) for d, q, _ in labels)
    fit = sorted((d, quality[d], tuple(quality_gam.features(t))) for d, t, _ in rows if d in quality and zlib.crc32(str(d).encode()) % 4 != 2)
    model = quality_gam.fit(np.array([f for *_, f in fit]), np.array([q for _, q, _ in fit], float))
    kept = [r for r in rows if model.score(np.array([quality_gam.features(r[1])]))[0] >= 0.7]
    sets = [(d, _set(t)) for d, t, _ in kept]
    lead = _components([d for d, _ in sets], [(a, b) for a, x in sets for b, y in sets if _near(x, y)])
    kept = [r for r in kept if lead[r[0]] == r[0]]
    allow = [re.compile(p) for p in secrets.ALLOW]
    kept = [(d, secrets.redact_text(t, _plain_base(t) + secrets.entropy_spans(t, _plain_base(t), allow)), s) for d, t, s in kept]
    size = Counter({s: 0 for *_, s in kept})
    for _, t, s in kept:
        size[s] += len(WORD.findall(t))
    target, copies = _targets(size), {}
    for s in size:
        own = sorted((_hash(d, t), d, len(WORD.findall(t))) for d, t, x in kept if x == s)
        whole = min(3, int(target[s] // size[s]))
        rest, total, cut = target[s] - whole * size[s], 0, -1
        for h, _, n in own if rest > 0 else ():
            if total + n >= rest:
                cut = h if total + n - rest < rest - total else h - 1
                break
            total += n
        copies |= {d: whole + (h <= cut) for h, d, _ in own}
    pieces = sentencepiece.load(sentencepiece.default_model())
    enc = sentencepiece.Encoder(pieces)
    want = Counter()
    for d, t, s in kept:
        if copies[d]:
            want[d, s, tuple(enc.encode([t])[0].tolist())] = copies[d]

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.source, tuple(r.piece_ids)) for r in got) == want
    assert all(r.round_trip for r in got)
    assert any(c > 1 for c in want.values()) and len(kept) < len(rows)

    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = now.columns
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == names or name == corpus_pipeline.STAGES[-1][0]
    assert Counter((r.doc_id, r.source, tuple(r.piece_ids)) for r in now.collect()) == want


def test_nothing_in(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
