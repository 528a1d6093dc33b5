"""Providers of model answers: a row in, the model's raw text out, and the choice between two of them.

The default provider works offline and gives the same answer always. Live ones get a
transport from outside. A provider asks again for an answer that isn't what was asked.
"""

from __future__ import annotations

import json
import re
import time
from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from riffle.functions.markup import object_in
from riffle.schema import CATEGORIES, LANGUAGES
from riffle.sources.web import retry_delay

#: What a model is told; enrich.prompt says the same as a Column.
INSTRUCTION = "Answer with one JSON object with summary, relevance (1-5), category ({categories}), language (es or en) and game.\nGame: {game}\nTitle: {title}\nText: {text}"
#: Tokens that an answer may take.
REPLY = 320

Row = tuple[str, str, str | None, str, str]


class BadOutput(Exception):
    """The model answered, but not with what was asked: this row has no answer."""


class Unreachable(Exception):
    """The provider can't be used at all."""


class Provider(Protocol):
    def answer(self, title: str, body: str, language: str | None, game: str, source_type: str) -> str:
        """Raw text for a row; raises BadOutput or Unreachable."""


def instruction(title: str, body: str, game: str, most: int = 800) -> str:
    return INSTRUCTION.replace("{categories}", ", ".join(CATEGORIES)).format(game=game, title=title, text=body[:most])


def estimate(row: Row) -> int:
    """Tokens that a call for a row takes: a third of its characters, and the answer."""
    return len(instruction(row[0], row[1], row[3])) // 3 + REPLY


def strip_py(raw: str) -> str:
    """What enrich.strip_reasoning leaves, then the first object, for checks beside the provider."""
    raw = re.sub(r"(?is)<think>.*?</think>|<think>.*$|```(?:json)?", "", raw)
    return object_in(raw.strip()) or ""


def check(raw: str, source_type: str) -> dict:
    """The fields of an answer; the twin of enrich.validated for one answer, beside its provider.

    relevance may be a number in a string; reddit needs no category, it is always rumor."""
    try:
        got = json.loads(strip_py(raw))
    except ValueError as e:
        raise BadOutput("no JSON") from e
    summary, rel, category, language = (got.get(k) for k in ("summary", "relevance", "category", "language"))
    if not isinstance(summary, str) or not summary.strip():
        raise BadOutput("summary_missing")
    rel = int(rel.strip()) if isinstance(rel, str) and re.fullmatch("[0-9]+", rel.strip()) else rel
    if isinstance(rel, bool) or not isinstance(rel, int) or not 1 <= rel <= 5:
        raise BadOutput("relevance_invalid")
    if source_type != "reddit" and (not isinstance(category, str) or category.strip() not in CATEGORIES):
        raise BadOutput("category_invalid")
    if not isinstance(language, str) or language.strip() not in LANGUAGES:
        raise BadOutput("language_invalid")
    return got


@dataclass
class Extractive:
    """Offline provider: the first sentence is the summary, the length the relevance, words the category."""

    words: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"lanzamiento": ("release", "launch"), "analisis": ("review",), "actualizacion": ("update", "patch")})

    def answer(self, title: str, body: str, language: str | None, game: str, source_type: str) -> str:
        text = " ".join((body or title or "").split())
        summary = re.split(r"(?<=[.!?])\s", text, maxsplit=1)[0][:280] or title
        low = f"{title} {body}".lower()
        category = next((c for c, ws in self.words.items() if any(w in low for w in ws)), "rumor")
        spoken = language if language in LANGUAGES else "en"
        return json.dumps({"summary": summary, "relevance": min(5, 1 + len(text) // 400), "category": category, "language": spoken, "game": ""})


@dataclass
class Limiter:
    """Tokens spent in a trailing minute stay under a share of the limit.

    One caller uses `wait` before a call. Tasks that work together keep equal limiters
    and ask `admit` which of their calls may go."""

    limit: int
    share: float = 0.8
    window: float = 60.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    spent: deque = field(default_factory=deque)
    tasks: int = 1

    def learn(self, headers: dict[str, str]) -> None:
        """Take over the provider's limit, where an answer's headers state one."""
        told = next((v for k, v in headers.items() if k.lower() == "x-ratelimit-limit-tokens"), None)
        try:
            limit = float(told or 0)
        except ValueError:
            return
        if 0 < limit < float("inf"):
            self.limit = max(1, int(limit / self.tasks))

    def trailing(self, now: float) -> int:
        while self.spent and now - self.spent[0][0] >= self.window:
            self.spent.popleft()
        return sum(n for _, n in self.spent)

    def wait(self, tokens: int) -> float:
        """Sleep once, until the oldest entry leaves the window, if the call would exceed; the seconds slept."""
        now, slept = self.clock(), 0.0
        if self.trailing(now) + tokens > self.share * self.limit and self.spent:
            slept = max(0.5, self.window - (now - self.spent[0][0]))
            self.sleep(slept)
        self.spent.append((self.clock(), tokens))
        return slept

    def admit(self, offers: Sequence[int | None], now: float, turn: int = 0) -> tuple[list[bool], float]:
        """Which of the calls offered (tokens; None: no call) may go now, the turn's first, and if
        none may, the seconds to wait. A call too large for an empty minute goes alone."""
        used, most, go = self.trailing(now), self.share * self.limit, [False] * len(offers)
        for k in range(len(offers)):
            i = (turn + k) % len(offers)
            if offers[i] is not None and (used + offers[i] <= most or used == 0):
                go[i], used = True, used + offers[i]
        if any(go) or all(x is None for x in offers):
            return go, 0.0
        return go, max(0.5, self.window - (now - self.spent[0][0]))


def answer_format() -> dict:
    """The strict output schema of an answer, as a chat endpoint takes it."""
    # The names of the answer's fields.
    text = {"type": "string"}
    fields = {"summary": text, "relevance": {"type": "integer", "enum": [1, 2, 3, 4, 5]}, "category": text | {"enum": list(CATEGORIES)}, "language": text | {"enum": list(LANGUAGES)}, "game": text}
    return {"type": "json_schema", "json_schema": {"name": "item", "strict": True, "schema": {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}}}


def pick_model(preferred: Sequence[str], available: Sequence[str], excluded: Sequence[str] = ()) -> str | None:
    """The first preferred model that is available, else the first available, by name, that isn't excluded."""
    return next((m for m in preferred if m in available), next((m for m in sorted(available) if not any(x in m.lower() for x in excluded)), None))


@dataclass
class Chat:
    """Provider over a chat endpoint; post(payload) returns (status, headers, text).

    An answer that fails the check is asked for once more; a 429 waits as long as its headers
    say; of a 400 that complains of the schema the row is asked for without one. A second
    such 400, and a 429 that lasts, are this row's own failure. A failed connection, status
    0, and any other status end in Unreachable. With `models`, which lists what is on offer,
    the first call picks the model: a preferred one, else one that isn't excluded.
    """

    post: Callable[[dict], tuple[int, dict[str, str], str]]
    model: str
    limiter: Limiter | None = None
    attempts: int = 2
    waits: int = 5
    sleep: Callable[[float], None] = time.sleep
    models: Callable[[], Sequence[str]] | None = None
    preferred: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ("whisper", "tts", "guard", "embed")
    told: dict[str, str] = field(default_factory=dict)
    _picked: bool = False

    def _pick(self) -> None:
        if self.models and not self._picked:
            try:
                self.model = pick_model((self.model, *self.preferred), self.models(), self.excluded) or self.model
            except Exception:  # noqa: BLE001  without a list the given model is used
                pass
        self._picked = True

    def payload(self, title: str, body: str, game: str, schema: bool = True) -> dict:
        out = {"model": self.model, "messages": [{"role": "user", "content": instruction(title, body, game)}]}
        return out | {"response_format": answer_format()} if schema else out

    def answer(self, title: str, body: str, language: str | None, game: str, source_type: str) -> str:
        self._pick()
        waits, bad, schema = 0, 0, True
        while True:
            if self.limiter:
                self.limiter.wait(estimate((title, body, language, game, source_type)))
            status, headers, text = self.post(self.payload(title, body, game, schema))
            self.told = headers
            if self.limiter:
                self.limiter.learn(headers)
            if status == 200:
                try:
                    check(text, source_type)
                    return text
                except BadOutput:
                    bad += 1
                    if bad >= self.attempts:
                        raise
            elif status == 429:
                if waits >= self.waits:
                    raise BadOutput("429 lasts")
                waits += 1
                self.sleep(retry_delay(headers))
            elif status == 400 and "json_validate_failed" in text:
                if not schema:
                    raise BadOutput("no answer fits the schema")
                schema = False
            else:
                raise Unreachable(f"status {status}")


@dataclass
class Local:
    """Provider over a generate endpoint nearby; post(payload) returns (status, text), status 0
    for a failed connection or a timeout. An answer that fails the check is asked for once more."""

    post: Callable[[dict], tuple[int, str]]
    model: str
    attempts: int = 2

    def answer(self, title: str, body: str, language: str | None, game: str, source_type: str) -> str:
        load = {"model": self.model, "prompt": instruction(title, body, game), "format": "json", "stream": False, "options": {"temperature": 0.1}}
        for left in range(self.attempts - 1, -1, -1):
            status, text = self.post(load)
            if status != 200:
                raise Unreachable(f"status {status}")
            try:
                check(text, source_type)
                return text
            except BadOutput:
                if not left:
                    raise
        raise BadOutput("not asked")


#: What a call came to: an answer, a bad one, an unreachable provider, or any other failure.
OK, BAD, DOWN, LOST = "ok", "bad", "down", "lost"


@dataclass
class Fallback:
    """Two providers and the state that chooses: bad answers in a row, or an unreachable local one, switch for good.

    `ask` calls without changing the state, `settle` changes it by the outcomes of calls that
    were made side by side: tasks that settle the same outcomes keep the same state."""

    local: Provider
    cloud: Provider | None = None
    most_bad: int = 3
    limiter: Limiter | None = None
    bad: int = 0
    switched: bool = False

    @property
    def current(self) -> Provider:
        return self.cloud if self.switched and self.cloud else self.local

    @property
    def last(self) -> bool:
        """No other provider is left to switch to."""
        return self.switched or self.cloud is None

    @property
    def shared(self) -> bool:
        """A call changes what the calls after it do: tasks that work together must know of each other's."""
        return self.limiter is not None or self.cloud is not None

    def ask(self, row: Row) -> tuple[str, str | None]:
        """(outcome, raw text)."""
        try:
            out = self.current.answer(*row)
            check(out, row[4])
            return OK, out
        except BadOutput:
            return BAD, None
        except Unreachable:
            return DOWN, None
        except Exception:  # noqa: BLE001  any other failure is this row's own
            return LOST, None

    def settle(self, outcomes: Sequence[str | None]) -> list[bool]:
        """Which of the calls with these outcomes (None: no call), in order, must be made again
        by the other provider; raises Unreachable when none is left."""
        last, again = self.last, []
        for x in outcomes:
            more = False
            if x == DOWN:
                if last:
                    raise Unreachable("no provider is left")
                self.switched = more = True
            elif x == BAD and not last:
                self.bad += 1
                if self.switched or self.bad >= self.most_bad:
                    self.switched, self.bad, more = True, 0, True
            elif x == OK:
                self.bad = 0
            again.append(more)
        return again

    def __call__(self, row: Row) -> str | None:
        """Raw text, or None where this row gets no answer; raises Unreachable when nothing is left."""
        while True:
            if self.limiter:
                self.limiter.wait(estimate(row))
            outcome, out = self.ask(row)
            if not self.settle([outcome])[0]:
                return out
