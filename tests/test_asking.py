"""Tasks that ask a model together: one limit, one switch, and answers that outlive a task."""

from __future__ import annotations

import json
import os
import threading
from collections import Counter

import pytest

from riffle.operators import asking, enrich, providers

GOOD = json.dumps({"summary": "s", "relevance": 3, "category": "rumor", "language": "en"})


class Clock:
    """A clock that all tasks share; a sleep of all of them together moves it once."""

    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now


def _crew(tasks, rows, make, clock):
    """Run ask_together in threads; (answers by pos, models)."""
    texts, together = [None] * tasks, threading.Barrier(tasks)
    out, models, errors = {}, [make() for _ in range(tasks)], []

    def work(me):
        def gather(text):
            texts[me] = text
            together.wait(10)
            got = list(texts)
            together.wait(10)
            return got

        def sleep(seconds):
            if together.wait(10) == 0:
                clock.now += seconds
            together.wait(10)

        if models[me].limiter:
            models[me].limiter.clock, models[me].limiter.sleep = clock, sleep
        try:
            for pos, raw in asking.ask_together(iter(rows[me]), models[me], me, gather):
                out[pos] = raw
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(tasks)]
    [t.start() for t in threads]
    [t.join(30) for t in threads]
    return out, models, errors


def _rows(tasks, each):
    return [[(t * 100 + i, (f"title {t} {i}", "body", "en", "g", "media")) for i in range(each)] for t in range(tasks)]


class Timed:
    def __init__(self, clock, seen, raw=GOOD):
        self.clock, self.seen, self.raw = clock, seen, raw

    def answer(self, *row):
        self.seen.append((self.clock(), providers.estimate(row)))
        return self.raw


def test_four_tasks_stay_under_the_minute():
    clock, seen = Clock(), []
    out, _, errors = _crew(4, _rows(4, 12), lambda: providers.Fallback(Timed(clock, seen), limiter=providers.Limiter(3_000)), clock)
    assert not errors and len(out) == 48 and set(out.values()) == {GOOD} and len(seen) == 48
    for at, _ in seen:
        assert sum(n for t, n in seen if at - 60 < t <= at) <= 0.8 * 3_000
    assert clock.now > 60  # it took several minutes, and not one call at a time
    assert max(Counter(t for t, _ in seen).values()) > 1


def test_a_limit_below_one_call_still_ends():
    clock, seen = Clock(), []
    out, _, errors = _crew(2, _rows(2, 2), lambda: providers.Fallback(Timed(clock, seen), limiter=providers.Limiter(10)), clock)
    assert not errors and len(out) == 4 and len({t for t, _ in seen}) == 4


def test_all_switch_after_the_third_bad_answer():
    clock, local, cloud = Clock(), [], []
    out, models, errors = _crew(4, _rows(4, 5), lambda: providers.Fallback(Timed(clock, local, '{"summary": ""}'), Timed(clock, cloud)), clock)
    assert not errors and all(m.switched for m in models)
    # The first round asks four rows: two fail, the third and the fourth go to the other provider.
    assert len(local) == 4 and list(out.values()).count(None) == 2 and len(cloud) == 18
    assert {m.bad for m in models} == {0}


def test_an_unreachable_last_provider_ends_every_task():
    class Gone:
        def answer(self, *row):
            raise providers.Unreachable

    out, _, errors = _crew(3, _rows(3, 2), lambda: providers.Fallback(Gone(), Gone()), Clock())
    assert not out and len(errors) == 3 and all(isinstance(e, providers.Unreachable) for e in errors)


class Counted:
    """A provider that notes each row it is asked for in a folder."""

    def __init__(self, folder):
        self.folder = folder

    def answer(self, title, *row):
        with open(f"{self.folder}/asked", "a") as f:
            f.write(title + "\n")
        return GOOD.replace('"s"', json.dumps(title))


def _misses(spark, n):
    rows = [(i, f"title {i}", "body", "en", "g", "media") for i in range(n)]
    return spark.createDataFrame(rows, "pos long, title string, body_text string, language string, game string, source_type string")


def test_a_barrier_stage_asks_each_row_once(spark, tmp_path):
    folder = str(tmp_path)
    rows = enrich.call_model(_misses(spark, 60), lambda: providers.Fallback(Counted(folder)), tasks=4).collect()
    assert {r.pos: json.loads(r.raw)["summary"] for r in rows} == {i: f"title {i}" for i in range(60)}
    assert Counter(open(f"{folder}/asked").read().splitlines()) == Counter(f"title {i}" for i in range(60))


def test_what_a_lost_task_had_answered_is_not_asked_again(spark, tmp_path):
    """The stage fails halfway and is run again: only the call under way is repeated."""
    folder, journal = str(tmp_path), f"file://{tmp_path}/journal"

    class Dying(Counted):
        def answer(self, title, *row):
            out = super().answer(title, *row)
            if title == "title 33" and not os.path.exists(f"{folder}/died"):
                open(f"{folder}/died", "w").close()
                raise SystemExit(1)
            return out

    make = lambda: providers.Fallback(Dying(folder))
    with pytest.raises(Exception):  # noqa: B017
        enrich.call_model(_misses(spark, 60), make, 4, journal).collect()
    before = Counter(open(f"{folder}/asked").read().splitlines())
    assert 0 < len(before) < 60
    rows = enrich.call_model(_misses(spark, 60), make, 4, journal).collect()
    assert len(rows) == 60 and all(json.loads(r.raw)["summary"] == f"title {r.pos}" for r in rows)
    asked = Counter(open(f"{folder}/asked").read().splitlines())
    assert set(asked) == {f"title {i}" for i in range(60)} and {k for k, n in asked.items() if n > 1} <= {"title 33"}


def test_nothing_to_ask(spark):
    assert enrich.call_model(_misses(spark, 0), lambda: providers.Fallback(providers.Extractive())).count() == 0


def test_the_prompt_is_the_same_as_a_column(spark):
    rows = _misses(spark, 3).withColumn("body_text", enrich.F.lit("é " * 500))
    got = rows.select("title", "body_text", "game", enrich.prompt(*(enrich.F.col(c) for c in ("title", "body_text", "game"))).alias("p")).collect()
    assert all(r.p == providers.instruction(r.title, r.body_text, r.game) for r in got)


def test_a_round_has_many_rows_and_nothing_shared_is_not_gathered():
    """Gathering takes about a second in Spark, so it may not be done for each row."""

    class Some:
        def answer(self, title, *row):
            n = int(title.split()[-1])
            if n % 6 == 2:
                raise RuntimeError("lost")
            if n % 50 == 0:
                raise providers.BadOutput("none")
            return GOOD

    def asked(model):
        gathered = []
        out = dict(asking.ask_together(iter(_rows(1, 2_500)[0]), model, 0, lambda text: gathered.append(text) or [text]))
        assert {pos for pos, raw in out.items() if raw is None} == {n for n in range(2_500) if n % 6 == 2 or n % 50 == 0}
        return len(gathered)

    assert asked(providers.Fallback(Some())) == 0
    assert asked(providers.Fallback(Some(), limiter=providers.Limiter(10**9))) < 10
    # With another provider a bad answer ends the round, as the next one may switch.
    assert asked(providers.Fallback(Some(), Some(), most_bad=9)) < 250


def test_equal_rows_of_a_round_are_asked_once(tmp_path):
    row, seen = ("title", "body", "en", "g", "media"), []
    model = providers.Fallback(Timed(Clock(), seen), limiter=providers.Limiter(10**9, clock=Clock()))
    out = dict(asking.ask_together(iter([(i, row) for i in range(5)]), model, 0, lambda text: [text], asking.Journal(str(tmp_path / "j"))))
    assert out == dict.fromkeys(range(5), GOOD) and len(seen) == 1
