"""Byte-level BPE against merges by hand and the library without cuts."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pytest
import regex

from riffle.llm import byte_bpe


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.read_ranks(byte_bpe.default_ranks()), byte_bpe.default_pattern())


def _by_hand(ranks, text):
    """Each match of the pattern from its bytes, the adjacent pair of least rank merged first."""
    out = []
    for m in regex.findall(byte_bpe.default_pattern(), text):
        bits = [bytes([c]) for c in m.encode()]
        while len(bits) > 1:
            rank, i = min((ranks.get(bits[i] + bits[i + 1], 1 << 40), i) for i in range(len(bits) - 1))
            if rank == 1 << 40:
                break
            bits[i : i + 2] = [bits[i] + bits[i + 1]]
        out += [ranks[x] for x in bits]
    return out


def _random_texts(n):
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\t", " \n ", "'s", "'", "don't", "Über", "日本語", "12", "٣", "!?", "é", " ", "　", "​", "\x1c", "word", "🎮", "\x85"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_ids_equal_merges_by_hand(spark, docs_of):
    ranks = byte_bpe.read_ranks(byte_bpe.default_ranks())
    texts = [None, "", " ", "   ", "a  b", *_random_texts(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "x y")]
    got = byte_bpe.decode(byte_bpe.encode(docs_of(rows))).collect()
    assert len(got) == len(rows) and {"score", "lang"} <= set(got[0].asDict())
    for r in got:
        assert r.ids == _by_hand(ranks, r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    for r in byte_bpe.digest(docs_of(rows)).collect():
        t = ("x y" if r.doc_id is None else texts[r.doc_id]) or ""
        ids = _by_hand(ranks, t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_cuts_change_nothing(codec, monkeypatch):
    whole = [codec.lib.encode_ordinary(t) for t in _random_texts(400)]
    monkeypatch.setattr(byte_bpe, "PART", 5)
    monkeypatch.setattr(byte_bpe, "_LONG_RUN", byte_bpe.re.compile(f"[{byte_bpe.SPACE}]{{3,}}"))
    for t, ids in zip(_random_texts(400), whole):
        assert "".join(p for p, _ in byte_bpe.parts(t)) == t
        assert codec.encode(t).tolist() == ids
    assert sum(len(list(byte_bpe.parts(t))) for t in _random_texts(400)) > 2000


@pytest.mark.parametrize("unit", [" ", "\n", "a", "é", "日本", "x ", "9", "'", " 　"])
def test_very_long_texts(codec, unit):
    began = time.perf_counter()
    text = "start" + unit * (2_000_000 // len(unit)) + "end"
    assert codec.decode(codec.encode(text)) == text.encode()
    assert time.perf_counter() - began < 30


def test_bytes_that_are_no_text_decode(spark):
    ranks = byte_bpe.read_ranks(byte_bpe.default_ranks())
    rows = spark.createDataFrame([([ranks[b"\xff"], ranks[b"\xc3"]],), (None,), ([],)], "ids array<int>")
    assert [r.decoded if r.decoded is None else bytes(r.decoded) for r in byte_bpe.decode(rows).collect()] == [b"\xff\xc3", None, b""]


def test_nothing(docs_of):
    assert byte_bpe.digest(docs_of([])).count() == 0
