"""Repair against all edits tried, in one task and in pieces."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from itertools import groupby

import pytest

from riffle.llm import conversation_repair as repair

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def _least(rows, faults):
    """(cost, audit, messages) of the best edits: all tried row by row, the best kept for each last initial."""
    ok = re.compile("s?(ua)*u?")

    def put(into, done, new):
        # Only the last initial and whether anything stands matter for what may follow.
        state = done if len(done) < 1 else ("s" if done == "s" else done[-1] + "!")
        if ok.fullmatch(done) and (state not in into or new[:2] < into[state][1][:2]):
            into[state] = (done, new)

    best = {"": ("", (0, "", ()))}

    def inserts(now):
        for _ in range(3):
            for done, (cost, audit, out) in list(now.values()):
                for role in ("user", "assistant"):
                    put(now, done + role[0], (cost + 5, audit + "I", (*out, (role, ""))))
        return now

    for (role, text), fault in zip(rows, faults):
        nxt = {}
        for done, (cost, audit, out) in list(inserts(best).values()):
            put(nxt, done, (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            if role[:1] in ("s", "u", "a"):
                put(nxt, done + role[:1], (cost + more, audit + "K", (*out, (role, text))))
            for new in ("user", "assistant"):
                put(nxt, done + new[0], (cost + 1 + more, audit + "R", (*out, (new, text))))
        best = nxt
    return min(new for done, new in inserts(best).values() if re.fullmatch("(s?(ua)+)?", done))


def _plain(table):
    """The contract's columns of each conv_id of rows (conv_id, turn, role, text)."""
    damaged = {c: [] for c, *_ in table}
    for c, turn, role, text in table:
        say = lambda v: " " if v is None else str(v)
        role, text = say(role), say(text)
        kind = zlib.crc32(f"{say(c)}:{say(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damaged[c] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for c, rows in damaged.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:100], hashlib.sha256(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in rows:
            bare = text.rstrip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = {t for t, *_ in rows if t is not None}
        cost, audit, messages = _least([r[1:] for r in rows], faults)
        out[c] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest(),
        )
    return out


def _conversations(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User", "umpire", None])
            text = rng.choice(["Yes.", "No!", "so", " \t", "", None, "é?", "Why? \n", "same.", "Long " * 40 + str(turn), f"{c} {turn}."])
            rows.append((c, rng.choice([turn, turn, turn, turn + 7, None, -3]), role, text))
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (rows[5][0], *rows[5][1:])] + [(5000, None, None, None)]
    return rows


def _table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int")


def _got(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[n] for n in names) for r in rows}


def test_every_conversation(spark):
    rows = _conversations(400)
    table = _table(spark, rows)
    assert _got(repair.report(repair.damage(table), table)) == _plain(rows)


def test_in_pieces(spark, monkeypatch):
    for name, value in (("LARGE_ROWS", 6), ("PIECE", 3), ("BLOCK", 2)):
        monkeypatch.setattr(repair, name, value)
    rows = _conversations(60, 2)
    rows += [(7, t // 3, random.Random(t).choice(["user", "assistant", "system"]), random.Random(t).choice(["a.", "b", f"{t}.", ""])) for t in range(200)]
    rows += [(8, 1, "user", "the same row.")] * 150 + [(None, t, "user", f"{t}!") for t in range(20)]
    table = _table(spark, rows)
    damaged = repair.damage(table)
    assert _got(repair.report(damaged, table)) == _plain(rows)
    again = {}
    for r in sorted(repair.repair(damaged).collect(), key=lambda r: (str(r.conv_id), r.position)):
        again.setdefault(r.conv_id, []).append(r)
    want = _plain(rows)
    for c, found in again.items():
        assert [r.position for r in found] == list(range(1, len(found) + 1))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in found).encode()).hexdigest() == want[c][-1]
        assert "".join(r.edit for r in found) == want[c][-2].replace("D", "")


def test_messages_fit_the_grammar(spark):
    rows = _conversations(80, 3)
    found = sorted(repair.repair(_table(spark, rows)).collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.position))
    for _, part in groupby(found, key=lambda r: r.conv_id):
        assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in part))


@pytest.mark.parametrize("seed", range(3))
def test_blocks_equal_one_search(seed):
    rng = random.Random(seed)
    for _ in range(60):
        codes = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randint(0, 40)))
        whole = next(iter(repair.search(codes, repair.START, True).values()))
        parts = [repair.table(codes[i : i + 7]) for i in range(0, len(codes), 7)]
        assert repair.finished(repair.together(parts)) == whole == repair.solve(codes)


def test_long_conversation_in_time():
    codes = "".join(random.Random(1).choice("uaUsd") for _ in range(20_000))
    began = time.perf_counter()
    cost, audit = repair.solve(codes)
    assert time.perf_counter() - began < 20 and len(audit) >= len(codes) and cost > 0


def test_nothing(spark):
    empty = _table(spark, [])
    assert repair.report(repair.damage(empty), empty).count() == 0 and repair.repair(empty).count() == 0
