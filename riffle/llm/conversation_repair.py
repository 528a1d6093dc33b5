"""Conversation structure repair by A* on the edit lattice.

A node of the lattice is (rows read, state of the role grammar `(s?(ua)+)?`); edges keep,
rerole or delete the next row or insert an empty message. The heuristic is a suffix sum: 2
for each row that must be deleted and, for each truncated row, the lesser of deleting it
and paying for it. No edge costs less than it takes off the heuristic, so a node is final
when it is first taken from the heap, whose keys are (cost plus heuristic, audit). Two
audits of one node and one cost are never prefixes of each other (they have as many rows,
and an insertion costs), so the least one extends the least ones of the nodes before it.

That also lets a conversation be cut: inserts belong to the row after them, a block of rows
is solved from each state to each state, and the tables of blocks are put together in
pairs. Conversations of up to LARGE rows are read in order by one task each, which holds
one at a time. Larger ones are dealt out in pieces by range, equal rows included: each
piece gives the table of its blocks, one task puts a conversation's tables together (some
bytes a row, as the audit itself has), and the edits go back to the rows piece by piece.
Only the hash of a repaired conversation, serial by nature, streams its rows through a task.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, sent, staged

#: Rows and characters up to which one task holds a conversation; rows of a piece of a larger one; rows solved by one search.
LARGE_ROWS, LARGE_CHARS, PIECE, BLOCK = 20_000, 32_000_000, 4_096, 64
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")

START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The one role of user and assistant that may follow each state.
_DUE = {state: "a" if state == USER else "u" for state in range(4)}
_ROLE = {"u": "user", "a": "assistant"}
#: What is still to be inserted when a conversation ends in a state.
_REST = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}

Table = dict[tuple[int, int], tuple[int, str]]


def search(codes: str, start: int, whole: bool) -> dict[int, tuple[int, str]]:
    """{state: (cost, audit)}: the cheapest edits of the rows `codes` from a state.

    A code is d for a row that must go, else the role's initial (x if it is none of s, u,
    a), a capital for a truncated row. whole: the rows are the last ones, and only the best
    way to an accepting state is returned; else the ways to all states, without inserts
    after the last row."""
    n = len(codes)
    least = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + (DELETE if codes[i] == "d" else min(DELETE, TRUNCATED) if codes[i].isupper() else 0)
    heap = [(least[0], "", 0, start)]
    closed, found = set(), {}
    while heap:
        f, audit, i, state = heapq.heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        cost = f - least[i]
        if i == n:
            if not whole:
                found[state] = (cost, audit)
                continue
            if state in (START, ASSISTANT):
                return {state: (cost, audit)}
        due = _DUE[state]
        heapq.heappush(heap, (f + INSERT, audit + "I", i, _AFTER[state, due]))
        if i == n:
            continue
        code, rest = codes[i], cost + least[i + 1]
        heapq.heappush(heap, (rest + DELETE, audit + "D", i + 1, state))
        if code == "d":
            continue
        rest += TRUNCATED if code.isupper() else 0
        own = code.lower()
        if (state, own) in _AFTER:
            heapq.heappush(heap, (rest, audit + "K", i + 1, _AFTER[state, own]))
        if own != due:
            heapq.heappush(heap, (rest + REROLE, audit + "R", i + 1, _AFTER[state, due]))
    return found


@lru_cache(20_000)
def _block(codes: str) -> Table:
    return {(i, j): best for i in range(4) for j, best in search(codes, i, False).items()}


def _joined(a: Table, b: Table) -> Table:
    out: Table = {}
    for (i, j), (cost, audit) in a.items():
        for k in range(4):
            if (j, k) in b:
                new = (cost + b[j, k][0], audit + b[j, k][1])
                if (i, k) not in out or new < out[i, k]:
                    out[i, k] = new
    return out


def together(tables: list[Table]) -> Table:
    """The table of all rows of tables, one after the other."""
    while len(tables) > 1:
        tables = [_joined(*tables[i : i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    return tables[0] if tables else {(i, i): (0, "") for i in range(4)}


def table(codes: str) -> Table:
    return together([_block(codes[i : i + BLOCK]) for i in range(0, len(codes), BLOCK)])


def finished(of: Table) -> tuple[int, str]:
    """(cost, audit) of a whole conversation from its table."""
    return min((cost + INSERT * len(_REST[j]), audit + _REST[j]) for (i, j), (cost, audit) in of.items() if i == START)


@lru_cache(100_000)
def _short(codes: str) -> tuple[int, str]:
    return next(iter(search(codes, START, True).values()))


def solve(codes: str) -> tuple[int, str]:
    """Least cost, and the ASCII-least audit that has it, of a whole conversation."""
    return _short(codes) if len(codes) <= BLOCK else finished(table(codes))


def _walk(codes: str, audit: str, state: int) -> Iterator[tuple[int, str, int]]:
    """(row, what becomes of it, state before) of each edit: K, D, or u/a where the role is
    set; row -1 and u/a for an insert."""
    row = 0
    for edit in audit:
        due, before = _DUE[state], state
        if edit == "I":
            yield -1, due, before
            state = _AFTER[state, due]
            continue
        if edit != "D":
            state = _AFTER[state, codes[row].lower() if edit == "K" else due]
        yield row, due if edit == "R" else edit, before
        row += 1


class _Rows:
    """What is counted over a conversation's rows, in order; parts can be added up."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None
        self.first = self.last = None
        self.codes: list[str] = []

    def add(self, turn: int | None, role: str, last: str, again: bool) -> None:
        initial = role[:1]
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.illegal += self.last is not None and self.last + initial not in LEGAL
        self.first, self.last = initial if self.first is None else self.first, initial
        if last == "":
            self.blank += 1
        elif again:
            self.duplicate += 1
        cut = last not in ("", ".", "!", "?") and not again
        self.truncated += cut
        code = "d" if last == "" or again else initial if initial in ("s", "u", "a") else "x"
        self.codes.append(code.upper() if cut else code)

    def append(self, p: dict) -> None:
        """Count a later piece, given as the row of part()."""
        for name in ("blank", "duplicate", "truncated"):
            setattr(self, name, getattr(self, name) + p[name])
        self.illegal += p["illegal"] + (self.last is not None and self.last + p["first"] not in LEGAL)
        self.first, self.last = p["first"] if self.first is None else self.first, p["last"]
        self.turns += p["turns"] - (p["low"] is not None and p["low"] == self.high)
        self.low, self.high = (p["low"] if self.low is None else self.low), (self.high if p["high"] is None else p["high"])

    def part(self) -> dict:
        names = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")
        return {x: getattr(self, x) for x in names} | {"codes": "".join(self.codes)}

    def report(self, conv_id, cost: int, audit: str, sha: str | None) -> dict:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        return {"conv_id": conv_id, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
                "illegal": self.illegal, "cost": cost, "audit": audit, "repaired_sha256": sha}


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_MESSAGES = "position long, role string, text string, edit string"
_KINDS = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _out(rows: list[dict], kind: pa.DataType, fields: str) -> pa.RecordBatch:
    schema = pa.schema([("conv_id", kind), *((name, _KINDS[t]) for name, t in (f.split() for f in fields.split(", ")))])
    return pa.RecordBatch.from_pylist(rows, schema)


def _seal(digest, first: bool, role: str, text: str) -> None:
    digest.update((("" if first else "\n") + role + ":" + text).encode())


def _conversation(conv_id, rows: list[tuple], messages: bool) -> list[dict]:
    """Report or repaired messages of a conversation of rows (turn, role, text, last)."""
    count, seen = _Rows(), set()
    for turn, role, text, last in rows:
        count.add(turn, role, last, (role, text) in seen)
        seen.add((role, text))
    codes = "".join(count.codes)
    cost, audit = solve(codes)
    out, digest, n = [], hashlib.sha256(), 0
    for row, edit, _ in _walk(codes, audit, START):
        if edit == "D":
            continue
        role = rows[row][1] if edit == "K" else _ROLE[edit]
        text = "" if row < 0 else rows[row][2]
        if messages:
            out.append({"conv_id": conv_id, "position": n + 1, "role": role, "text": text, "edit": "I" if row < 0 else "K" if edit == "K" else "R"})
        else:
            _seal(digest, n == 0, role, text)
        n += 1
    return out if messages else [count.report(conv_id, cost, audit, digest.hexdigest())]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _flushed(found: Iterator[list[dict]], kind: Callable[[], pa.DataType], fields: str) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for rows in found:
        held += rows
        if len(held) >= 2_000:
            yield _out(held, kind(), fields)
            held = []
    if held:
        yield _out(held, kind(), fields)


def _grouped(rows: Iterator[tuple]) -> Iterator[tuple[object, list[tuple]]]:
    key, held = None, []
    for conv_id, *row in rows:
        if held and conv_id != key:
            yield key, held
            held = []
        key = conv_id
        held.append(tuple(row))
    if held:
        yield key, held


def _prepared(rows: DataFrame) -> DataFrame:
    """Rows without nulls in role and text, the last character of a text that isn't white space, and keys of the order."""
    say = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return (
        rows.select("conv_id", F.col("turn").cast("long").alias("turn"), say("role"), say("text"))
        .withColumn("last", F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1)))
        .withColumn("head", F.left("text", F.lit(100)))
        .withColumn("sha", F.sha2("text", 256))
    )


_ORDER = ["conv_id", "turn", "role", "head", "sha"]


def _with(rows: DataFrame, large: DataFrame, how: str) -> DataFrame:
    named = sent(large.select(F.col("conv_id").alias("_conv")))
    return rows.join(named, F.col("conv_id").eqNullSafe(F.col("_conv")), how)


def _repair(rows: DataFrame, messages: bool) -> DataFrame:
    id_type = rows.schema["conv_id"].dataType.simpleString()
    ready = _prepared(rows)
    fields = _MESSAGES if messages else _REPORT

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: list[pa.DataType] = []

        def typed() -> Iterator[pa.RecordBatch]:
            for b in batches:
                kind[:] = [b.column(0).type]
                yield b

        yield from _flushed((_conversation(k, part, messages) for k, part in _grouped(_in_order(typed()))), lambda: kind[0], fields)

    sizes = ready.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    large = staged(sizes.where((F.col("n") > LARGE_ROWS) | (F.col("chars") > LARGE_CHARS)).select("conv_id"), "large-conversations")
    none = large.isEmpty()
    rest = ready if none else _with(ready, large, "left_anti")
    done = rest.repartition("conv_id").sortWithinPartitions(*_ORDER).select("conv_id", "turn", "role", "text", "last").mapInArrow(small, f"conv_id {id_type}, {fields}")
    return done if none else done.unionByName(_large(_with(ready, large, "left_semi"), id_type, messages))


_PIECE = "at long, seqs array<long>, codes string, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string, audits binary"


def _large(ready: DataFrame, id_type: str, messages: bool) -> DataFrame:
    """The same for conversations that no task should hold."""
    dealt = ready.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*_ORDER, "copy").sortWithinPartitions(*_ORDER, "copy")
    rows = staged(dealt.select("conv_id", F.monotonically_increasing_id().alias("seq"), "turn", "role", "text", "last"), "conversation-rows")
    named = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    key = F.sha2(F.concat(named, F.lit("\n"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("key")
    slim = staged(rows.select("conv_id", "seq", "turn", F.left("role", F.lit(1)).alias("initial"), "last", key), "conversation-slim")
    firsts = staged(slim.groupBy("key").agg(F.min("seq").alias("one")), "conversation-firsts")
    marked = looked_up(slim, firsts, "key").select("conv_id", "seq", "turn", "initial", "last", (F.col("seq") != F.col("one")).alias("again"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv_id, kind, part in _pieces(batches):
            count = _Rows()
            for _, turn, initial, last, again in part:
                count.add(turn, initial, last, again)
            made = count.part()
            yield _out([made | {"conv_id": conv_id, "at": part[0][0], "seqs": [p[0] for p in part], "audits": pickle.dumps(table(made["codes"]))}], kind, _PIECE)

    def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, held, kind = None, [], None
        for b in batches:
            kind = b.column(0).type
            for conv_id, *row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (conv_id != key or len(held) == PIECE):
                    yield key, kind, held
                    held = []
                key = conv_id
                held.append(tuple(row))
        if held:
            yield key, kind, held

    pieces = staged(marked.repartitionByRange("seq").sortWithinPartitions("seq").mapInArrow(cut, f"conv_id {id_type}, {_PIECE}"), "conversation-pieces")
    solved_fields = _REPORT + ", at long, state int, position long"

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["at", *(f.split()[0] for f in _PIECE.split(", ")[2:])]

        def close(conv_id, kind, held: list[dict]) -> Iterator[pa.RecordBatch]:
            count = _Rows()
            for p in held:
                count.append(p)
            cost, audit = finished(together([pickle.loads(p["audits"]) for p in held]))
            yield _out([count.report(conv_id, cost, audit, None) | {"at": None, "state": None, "position": None}], kind, solved_fields)
            # Each row's edit ends with its own letter; what is left is inserted at the end.
            own = np.flatnonzero(np.frombuffer(audit.encode(), np.uint8) != ord("I"))
            ends = own[np.cumsum([len(p["codes"]) for p in held]) - 1] + 1
            ends[-1] = len(audit)
            state, position, begin = START, 0, 0
            for p, end in zip(held, ends):
                part = audit[begin:end]
                yield _out([{"conv_id": conv_id, "audit": part, "at": p["at"], "state": state, "position": position}], kind, solved_fields)
                for row, edit, before in _walk(p["codes"], part, state):
                    position += edit != "D"
                    state = before if edit == "D" else _AFTER[before, p["codes"][row].lower() if edit == "K" else edit]
                begin = end

        key, held, kind = None, [], None
        for b in batches:
            kind = b.column(0).type
            for conv_id, *row in zip(*(c.to_pylist() for c in b.columns)):
                if held and conv_id != key:
                    yield from close(key, kind, held)
                    held = []
                key = conv_id
                held.append(dict(zip(names, row)))
        if held:
            yield from close(key, kind, held)

    solved = staged(
        pieces.drop("seqs").repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(compose, f"conv_id {id_type}, {solved_fields}"), "conversation-solved"
    )
    ways = solved.where(F.col("at").isNotNull()).select("at", "audit", "state", "position")

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for seqs, codes, audit, state, position in zip(*(c.to_pylist() for c in b.columns)):
                out: list[tuple] = []
                row = 0
                for at, edit, _ in _walk(codes, audit, state):
                    if at >= 0:
                        row = at + 1
                    if edit != "D":
                        position += 1
                        # Inserts after the last row hang on it.
                        out.append((seqs[at if at >= 0 else min(row, len(seqs) - 1)], position, _ROLE.get(edit), "I" if at < 0 else "K" if edit == "K" else "R"))
                cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))]
                if out:
                    yield pa.RecordBatch.from_arrays(cols, ["seq", "position", "new_role", "edit"])

    changed = pieces.select("at", "seqs", "codes").join(ways, "at").select("seqs", "codes", "audit", "state", "position")
    made = changed.mapInArrow(edits, "seq long, position long, new_role string, edit string").join(rows, "seq")
    out = made.select("conv_id", "position", F.coalesce("new_role", "role").alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"), "edit")
    if messages:
        return out

    def seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, n, kind = None, None, 0, None
        for b in batches:
            kind = b.column(0).type
            for conv_id, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if digest is None or conv_id != key:
                    if digest is not None:
                        yield _out([{"conv_id": key, "sha": digest.hexdigest()}], kind, "sha string")
                    key, digest, n = conv_id, hashlib.sha256(), 0
                _seal(digest, n == 0, role, text)
                n += 1
        if digest is not None:
            yield _out([{"conv_id": key, "sha": digest.hexdigest()}], kind, "sha string")

    ordered = out.repartition("conv_id").sortWithinPartitions("conv_id", "position").select("conv_id", "role", "text")
    sealed = ordered.mapInArrow(seal, f"conv_id {id_type}, sha string").withColumnRenamed("conv_id", "_conv")
    reports = solved.where(F.col("at").isNull()).drop("at", "state", "position", "repaired_sha256")
    empty = hashlib.sha256(b"").hexdigest()
    return reports.join(sealed, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(*reports.columns, F.coalesce("sha", F.lit(empty)).alias("repaired_sha256"))


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, edit) of the repaired conversations of rows (conv_id,
    turn, role, text), position from 1; edit is K for a row kept, R for a new role and I for
    an inserted message, whose text is empty. A conversation without messages has no row.

    A null role or text counts as one space, a null conv_id as a conversation of its own.
    Rows go by turn, nulls first; of one turn by role, then by the first 100 characters of
    the text, then by its hash. A row is blank, or a duplicate of an earlier row's role and
    text, or truncated: the first that holds. A role whose first letter is none of s, u, a,
    such as the empty one, can't be kept. Other columns are ignored."""
    return _repair(rows, True)


def report(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)
    of each conversation of rows, of which repair() gives the messages. gaps beyond the
    range of a long are its end. With conversations, all their conv_ids are returned, those
    without rows with zeros, an empty audit and the hash of nothing."""
    found = _repair(rows, False)
    if conversations is None:
        return found
    ids = conversations.select(F.col("conv_id").alias("_conv")).distinct()
    all_ids = ids.join(found, F.col("_conv").eqNullSafe(F.col("conv_id")), "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return all_ids.select(F.col("_conv").alias("conv_id"), *[F.coalesce(c, F.lit(empty[c]) if c in empty else F.lit(0)).cast(found.schema[c].dataType).alias(c) for c in found.columns[1:]])


def damage(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with faults, chosen by crc32 of
    `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 removes its full stops,
    exclamation and question marks, 3 repeats it, 4 makes its role user. A null is one
    space in the choice, the role and the text; conv_id and turn stay null."""
    say: Callable[[str], Column] = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", say("role").alias("role"), say("text").alias("text"), (F.crc32(F.concat(say("conv_id"), F.lit(":"), say("turn"))) % 20).alias("fault"))
    fault = F.col("fault")
    return rows.where("fault != 0").select(
        "conv_id", "turn",
        F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")
