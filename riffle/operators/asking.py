"""Asking a model for many rows from several tasks that share one limit and one choice of provider.

The tasks run as a barrier stage. In rounds each offers its next rows; all gather the
offers and admit, by the same rule, those that fit into the minute's tokens; each task makes
its admitted calls one after the other, until some seconds are over or a call has an outcome
that all must know of; all gather their outcomes and settle them in the same order. So
the spent tokens, the learnt limit and the bad answers in a row are the same in all tasks
without a server. Spark takes about a second to gather, so a round has many rows; where there is
neither a limit nor another provider, nothing is shared and nothing gathered.
Each answer is put into a journal on shared storage as soon as it is
there: when a task is lost, its stage begins anew and finds there what was answered.
"""

from __future__ import annotations

import hashlib
import json
import logging
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame

from .providers import BAD, DOWN, OK, Fallback, Row, estimate
from .tables import shared_dir

Gather = Callable[[str], list[str]]
#: Rows that a task offers in a round, and the seconds after which it begins no further call of the round.
OFFERED, ROUND = 1_000, 10.0


@dataclass
class Journal:
    """Answers by row, a small file each, under a folder that all tasks reach. A file is written
    beside its place and then moved, so that none is ever read half."""

    base: str

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.base)

    @staticmethod
    def key(row: Row) -> str:
        return hashlib.sha256(json.dumps(row).encode()).hexdigest()

    def get(self, row: Row) -> dict | None:
        store, base = self._fs()
        try:
            with store.open_input_file(f"{base}/{self.key(row)}.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def put(self, row: Row, raw: str | None) -> None:
        store, base = self._fs()
        store.create_dir(base, recursive=True)
        beside, place = f"{base}/.{uuid.uuid4().hex}", f"{base}/{self.key(row)}.json"
        with store.open_output_stream(beside) as f:
            f.write(json.dumps({"raw": raw}).encode())
        store.move(beside, place)


def _dealt(each: list[list], turn: int = 0) -> list[tuple[int, int]]:
    """(task, place) of what the tasks have: the first of each, then the second of each, beginning with the turn's task."""
    return [(t, i) for i in range(max(map(len, each))) for k in range(len(each)) if i < len(each[t := (turn + k) % len(each)])]


def ask_together(rows: Iterator[tuple[int, Row]], model: Fallback, me: int, gather: Gather, journal: Journal | None = None) -> Iterator[tuple[int, str | None]]:
    """(pos, raw) of this task's rows; raw is None where a row has no answer. gather(text) returns
    the texts of all tasks, in order, once all have called it; every task calls it as often."""
    if not model.shared:
        me, gather = 0, lambda text: [text]
    turn, pending, sleep = 0, [], model.limiter.sleep if model.limiter else None
    clock = model.limiter.clock if model.limiter else lambda: 0.0
    while True:
        while len(pending) < OFFERED and (row := next(rows, None)) is not None:
            known = journal.get(row[1]) if journal else None
            if known is None:
                pending.append(row)
            else:
                yield row[0], known["raw"]
        # The first task's clock is everyone's.
        offers = [json.loads(x) for x in gather(json.dumps({"tokens": [estimate(row) if model.limiter else 0 for _, row in pending], "now": clock()}))]
        asked = [x["tokens"] for x in offers]
        if not any(asked):
            return
        order = _dealt(asked, turn)
        go, pause = model.limiter.admit([asked[t][i] for t, i in order], offers[0]["now"]) if model.limiter else ([True] * len(order), 0.0)
        turn += 1
        if pause:
            sleep(pause)
            continue
        began, calls, gone, told = time.monotonic(), [], set(), {}
        for i in [i for (t, i), on in zip(order, go) if on and t == me]:
            if calls and time.monotonic() - began > ROUND:
                break
            pos, row = pending[i]
            # An equal row may have been answered since.
            known = journal.get(row) if journal else None
            if known is not None:
                gone.add(i)
                yield pos, known["raw"]
                continue
            outcome, raw = model.ask(row)
            if journal and outcome == OK:
                journal.put(row, raw)
            told |= getattr(model.current, "told", None) or {}
            calls.append((i, outcome, raw))
            if outcome == DOWN or (outcome == BAD and not model.last):
                break
        said = {"outcomes": [x for _, x, _ in calls], "tokens": sum(asked[me][i] for i, _, _ in calls), "told": told, "now": clock()}
        ends = [json.loads(x) for x in gather(json.dumps(said))]
        if model.limiter:
            # A call of the round counts as made at its end, so no minute has more than the limit.
            if spent := sum(x["tokens"] for x in ends):
                model.limiter.spent.append((ends[0]["now"], spent))
            for x in ends:
                model.limiter.learn(x["told"])
        outcomes = [x["outcomes"] for x in ends]
        settled = _dealt(outcomes)
        again = dict(zip(settled, model.settle([outcomes[t][i] for t, i in settled])))
        for k, (i, outcome, raw) in enumerate(calls):
            if not again[me, k]:
                if journal and outcome != OK:
                    journal.put(pending[i][1], None)
                gone.add(i)
                yield pending[i][0], raw
        pending = [x for i, x in enumerate(pending) if i not in gone]


def call_model(misses: DataFrame, make: Callable[[], Fallback], tasks: int = 4, journal: str | None = "") -> DataFrame:
    """(pos, raw): the provider's answer for each row, null where it failed. `tasks` tasks ask
    side by side, no more than run at once. journal: a folder URI that driver and executors
    share, by default a new one in the shared folder; None keeps no journal. With one, rows
    that are equal in what the model sees, and rows of a task that is lost, are asked for
    once; with none, a lost task asks again. make() must give every task the same state."""
    spark = misses.sparkSession
    tasks = max(1, min(tasks, spark.sparkContext.defaultParallelism))
    kept = Journal(journal or f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}") if journal is not None else None
    if kept and not journal:
        try:
            kept._fs()
        except Exception as e:  # noqa: BLE001  the shared folder may be on storage that only Spark's readers reach
            logging.getLogger(__name__).warning("no journal of answers: %s", e)
            kept = None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        at = BarrierTaskContext.get() if tasks > 1 else None
        rows = ((r.pos, (r.title or "", r.body_text or "", r.language, r.game or "", r.source_type)) for f in frames for r in f.itertuples(index=False))
        held: list[tuple[int, str | None]] = []
        for got in ask_together(rows, model, at.partitionId() if at else 0, at.allGather if at else lambda x: [x], kept):
            held.append(got)
            if len(held) == 1_000:
                yield pd.DataFrame(held, columns=["pos", "raw"])
                held = []
        if held:
            yield pd.DataFrame(held, columns=["pos", "raw"])

    dealt = misses.select("pos", "title", "body_text", "language", "game", "source_type").repartition(tasks)
    return dealt.mapInPandas(run, "pos long, raw string", barrier=tasks > 1)
