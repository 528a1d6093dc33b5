"""Entity matching and detection. The rules look at the places of words in a title, so
they run in Arrow batches, after the native filters; results are a struct (name, reason)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.domain import DomainPack, Rules
from riffle.functions.text import fold, fold_py

from .mentions import Automaton, first, separate

_EDGE = "\"'`.,;:!?()[]{}«»“”‘’¡¿…-–—*"


def tokens(title: str) -> list[str]:
    return [w for w in (t.strip(_EDGE) for t in title.replace("’", "'").split()) if w]


def _folded(words: list[str]) -> list[str]:
    return [fold_py(w).replace(" ", "") for w in words]


def _is_reference_at(words: list[str], at: int, end: int, pack: DomainPack) -> bool:
    """Whether the mention words[at:end] of a folded title only compares, negates or dismisses."""
    after = words[end:]
    if after and (after[0] in pack.comparison_suffixes or " ".join(after[:2]) in pack.comparison_suffixes):
        return True
    before = words[max(0, at - 10) : at]
    stem = lambda i: before[i] in pack.contraction_stems and i + 1 < len(before) and before[i + 1] == "t"
    if any(w in pack.negations for w in before[-2:]) or len(before) > 1 and stem(len(before) - 2):
        return True
    # A list inherits a negation unless a verb of playing stands between.
    first_no = next((i for i, w in enumerate(before) if w in pack.negations), None)
    first_no = next((i for i in range(len(before)) if stem(i)), None) if first_no is None else first_no
    if first_no is not None and not any(w in pack.playing for w in before[first_no + 1 :]):
        return True
    if after and after[0] in pack.dismissals:
        return True
    no = after.index("no") if "no" in after[:4] else None
    return no is not None and (no + 1 == len(after) or after[no + 1] in pack.no_follow)


def is_reference(title: str, name: str, pack: DomainPack) -> bool:
    """Whether the first mention of name in title only compares, negates or dismisses it."""
    words, found = fold_py(title).split(), Automaton([fold_py(name).strip()])
    at = next(found.find(words), None)
    return at is not None and _is_reference_at(words, at[0], at[1], pack)


class Matcher:
    """The names of rules and the known titles of a pack, in one automaton that is built once."""

    def __init__(self, rules: Rules | None, pack: DomainPack):
        self.rules, self.pack = rules or Rules((), ()), pack
        phrases: dict[str, int] = {}
        #: Of each phrase, what it is a name of: (kind, number of the rule or title, its place among the names).
        self.uses: list[list[tuple[str, int, int]]] = []

        def add(text: str, use: tuple[str, int, int]) -> None:
            number = phrases.setdefault(fold_py(text).strip(), len(phrases))
            if number == len(self.uses):
                self.uses.append([])
            self.uses[number].append(use)

        for kind, part in (("include", self.rules.include), ("exclude", self.rules.exclude)):
            for i, r in enumerate(part):
                for j, name in enumerate(r.names):
                    add(name, (kind, i, j))
        self.titles = list(pack.known_titles.items())
        for i, (alias, _) in enumerate(self.titles):
            add(alias, ("known", i, 0))
        self.found = Automaton(list(phrases))

    def _mentions(self, words: list[str]) -> dict[tuple[str, int], list[tuple[int, int, int]]]:
        out: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
        for start, end, number in self.found.find(words):
            for kind, i, j in self.uses[number]:
                out.setdefault((kind, i), []).append((start, end, j))
        return out

    def _only_context(self, words: list[str], mentions: list[tuple[int, int, int]]) -> bool:
        """Whether the first mention, with up to two numbers that follow at once, is a reference."""
        start, end, _ = first(mentions)
        stop = end
        while stop < len(words) and stop - end < 2 and words[stop].isdigit():
            stop += 1
        return _is_reference_at(words, start, stop, self.pack)

    def rule(self, title: str, body: str) -> str | None:
        """Name of the first included rule that is the main topic: its first mention in the
        title is no reference, or the body has two. None where an excluded one is mentioned."""
        head, rest = fold_py(title).split(), fold_py(body).split()
        got = self._mentions(head + rest)
        if any(kind == "exclude" for kind, _ in got):
            return None
        for i, r in enumerate(self.rules.include):
            all_ = got.get(("include", i), ())
            inside = [m for m in all_ if m[1] <= len(head)]
            if inside and not self._only_context(head, inside) or separate(m for m in all_ if m[0] >= len(head)) >= 2:
                return r.name
        return None

    def context(self, title: str) -> list[str]:
        """Included rules that the title mentions as a reference only."""
        words = fold_py(title).split()
        got = self._mentions(words)
        return [r.name for i, r in enumerate(self.rules.include) if ("include", i) in got and self._only_context(words, got["include", i])]

    def known(self, title: str, guarded: bool = True) -> list[str]:
        """Canonical names of the known titles in a title, the longest first, without references if guarded."""
        words = fold_py(title).split()
        found = [(self.titles[i], first(m)) for (kind, i), m in sorted(self._mentions(words).items()) if kind == "known"]
        found.sort(key=lambda x: -len(x[0][0]))
        return list(dict.fromkeys(name for (_, name), (start, end, _) in found if not (guarded and _is_reference_at(words, start, end, self.pack))))


def mention_count(text: str, name: str) -> int:
    """Mentions of name in text as whole words, a number after it or not."""
    return sum(1 for _ in Automaton([fold_py(name).strip()]).find(fold_py(text).split()))


def match_rules(title: str, body: str, rules: Rules, pack: DomainPack) -> str | None:
    return Matcher(rules, pack).rule(title, body)


def context_matches(title: str, rules: Rules, pack: DomainPack) -> list[str]:
    return Matcher(rules, pack).context(title)


def known_titles(title: str, pack: DomainPack, guarded: bool = True) -> list[str]:
    return Matcher(None, pack).known(title, guarded)


def anchor_name(title: str, pack: DomainPack, names: Matcher | None = None) -> str | None:
    """Name before an event word: of all such, one with a known title, then the shortest, then the first."""
    words = tokens(title)
    low = _folded(words)
    names = names or Matcher(None, pack)
    best = None
    for i, w in enumerate(low):
        if w not in pack.anchors:
            continue
        a, b = 0, i
        while a < b and low[a] in pack.leading_noise:
            a += 1
        while b > a and low[b - 1] in pack.post_name:
            b -= 1
        part = words[a:b]
        if not part or any(x in pack.generic_tokens or x in pack.non_game for x in low[a:b]):
            continue
        part = part[:6]
        part[-1] = re.sub("'s$", "", part[-1])
        name = " ".join(part)
        if len(name) < 2:
            continue
        rank = (0 if names.known(name, guarded=False) else 1, len(part))
        if best is None or rank < best[0]:
            best = (rank, name)
    return best[1] if best else None


def clean_anchor(name: str | None, pack: DomainPack) -> str | None:
    """The anchor's name, unless it starts with no letter, is a place or a single word."""
    if not name or not name[0].isalpha() or fold_py(name).strip() in pack.places or len(name.split()) < 2:
        return None
    return name


def rescued(title: str, pack: DomainPack, names: Matcher | None = None) -> bool:
    """Whether an anchor's name of at most five words, not all noise, speaks for the topic."""
    name = anchor_name(title, pack, names)
    noise = {*pack.generic_tokens, *pack.non_game, *pack.stop, *pack.places}
    return bool(name) and len(name.split()) <= 5 and any(w not in noise for w in _folded(name.split()))


def rescued_name(title: Column, pack: DomainPack) -> Column:
    """The anchor's name where it speaks for the topic, else null."""

    names = Matcher(None, pack)

    @F.pandas_udf("string")
    def found(titles: pd.Series) -> pd.Series:
        return titles.fillna("").map(lambda t: anchor_name(t, pack, names) if rescued(t, pack, names) else None)

    return found(title) if pack.anchors else F.lit(None).cast("string")


def contrast_subject(title: str, pack: DomainPack) -> str | None:
    """One to three capitalised words before a verb that contrasts or an isn't."""
    words = tokens(title)
    low = [w.lower() for w in words]
    for i, w in enumerate(low):
        if w not in pack.contrast_verbs and w not in ("isn't", "aren't", "wasn't"):
            continue
        for span in (3, 2, 1):
            part = words[i - span : i] if i >= span else []
            if part and all(p[:1].isupper() or p[:1].isdigit() for p in part) and fold_py(part[0]).strip() not in pack.pronouns:
                return " ".join(part)
    return None


def after_playing(title: str, pack: DomainPack) -> str | None:
    """The capitalised run after playing or played."""
    m = re.search(rf"\b(?:{'|'.join(pack.playing)})\s+((?:[A-Z0-9][\w':-]*\s*)+)", title) if pack.playing else None
    name = m[1].strip(_EDGE + " ") if m else ""
    return name if name and fold_py(name).strip() not in pack.pronouns else None


def detect(title: str, pack: DomainPack, hint: str | None = None, names: Matcher | None = None) -> tuple[str | None, str]:
    """(name, reason): hint, known title or anchor, contrast subject, after playing, or none."""
    if hint:
        return hint, "hint"
    names = names or Matcher(None, pack)
    known = next(iter(names.known(title)), None)
    anchor = clean_anchor(anchor_name(title, pack, names), pack)
    if known and anchor:
        return (anchor, "anchor") if fold_py(anchor).startswith(fold_py(known)) else (known, "known")
    if known or anchor:
        return (known, "known") if known else (anchor, "anchor")
    if name := contrast_subject(title, pack):
        return name, "subject"
    if name := after_playing(title, pack):
        return name, "playing"
    return None, "none"


def steam_hint(source: Column, kind: Column) -> Column:
    """Name of the app that a store row's source gives."""
    return F.when((kind == "steam") & source.startswith("Steam · "), F.substring(source, 9, 1000))


def assign_games(df: DataFrame, rules: Rules, pack: DomainPack, generic: str = "General", reddit_game: str = "Reddit Rumors") -> DataFrame:
    """df with game and match_reason: reddit's own game, the first matching rule, a detected name, or generic."""

    names = df.sparkSession.sparkContext.broadcast(Matcher(rules, pack))  # configuration files, read whole by the driver

    @F.pandas_udf("name string, reason string")
    def found(titles: pd.Series, bodies: pd.Series, hints: pd.Series) -> pd.DataFrame:
        out = []
        for t, b, h in zip(titles.fillna(""), bodies.fillna(""), hints):
            name = names.value.rule(t, b)
            out.append((name, "config") if name else detect(t, pack, h, names.value))
        return pd.DataFrame(out, columns=["name", "reason"])

    hinted = df.withColumn("_hint", steam_hint(F.col("source"), F.col("source_type")))
    other = hinted.where("source_type <> 'reddit'").withColumn("_m", found("title", fold(F.col("body_text")), "_hint"))
    rest = ["game", "match_reason"]
    keep = [c for c in df.columns if c not in rest]
    matched = other.select(*keep, F.coalesce(F.col("_m")["name"], F.lit(generic)).alias("game"), F.col("_m")["reason"].alias("match_reason"))
    reddit = df.where("source_type = 'reddit'").select(*keep, F.lit(reddit_game).alias("game"), F.lit("reddit").alias("match_reason"))
    return matched.unionByName(reddit)

