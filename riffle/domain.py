"""Domain packs: the lexicons and rules that the operators take as parameters, and their configuration files."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from typing import Any

from riffle.functions.text import fold_py

PLATFORMS = ("pc", "playstation", "xbox", "nintendo", "mobile")


class ConfigError(ValueError):
    """A configuration file that can't be used; the message names the entry."""


@dataclass(frozen=True)
class Rule:
    """An entity to look for: its name, other names, logo and platforms."""

    name: str
    aliases: tuple[str, ...] = ()
    logo: str | None = None
    platform: tuple[str, ...] = ()

    @property
    def names(self) -> tuple[str, ...]:
        return (self.name, *self.aliases)


@dataclass(frozen=True)
class DomainPack:
    """Word lists of a domain. All matching is on folded text, so entries are folded on load."""

    strong_positive: tuple[str, ...] = ()
    weak_positive: tuple[str, ...] = ()
    strong_negative: tuple[str, ...] = ()
    weak_negative: tuple[str, ...] = ()
    suppress: tuple[str, ...] = ()
    entertainment: tuple[str, ...] = ()
    feed_hard_negative: tuple[str, ...] = ()
    feed_soft_negative: tuple[str, ...] = ()
    feed_positive: tuple[str, ...] = ()
    known_titles: dict[str, str] = field(default_factory=dict)
    game_keys: dict[str, str] = field(default_factory=dict)
    anchors: tuple[str, ...] = ()
    leading_noise: tuple[str, ...] = ()
    generic_tokens: tuple[str, ...] = ()
    non_game: tuple[str, ...] = ()
    post_name: tuple[str, ...] = ()
    # Words that make a mention a comparison, negation or dismissal.
    comparison_suffixes: tuple[str, ...] = (
        "esque", "like", "style", "styled", "inspired", "evoking", "clone", "clones", "ripoff", "rip off",
        "ripoffs", "knockoff", "knock offs", "wannabe", "homage",
    )
    negations: tuple[str, ...] = (
        "not", "no", "never", "neither", "nor", "unlike", "without", "except",
        "rather", "instead", "than", "versus", "vs", "unless", "beyond",
    )
    contraction_stems: tuple[str, ...] = (
        "isn", "aren", "arent", "wasn", "weren", "werent", "aint", "didn", "doesn", "don", "hant",
        "hadn", "shouldn", "wouldn", "won", "can", "couldn", "needn", "mustn",
    )
    playing: tuple[str, ...] = ("playing", "played")
    dismissals: tuple[str, ...] = ("nope", "nah", "nada")
    no_follow: tuple[str, ...] = ("thanks", "thank", "thx", "way", "worries")
    contrast_verbs: tuple[str, ...] = ("mixes", "blends", "combines", "feels", "looks")
    pronouns: tuple[str, ...] = ("it", "this", "that", "he", "she", "they", "we", "i", "you", "there", "what", "who")
    places: tuple[str, ...] = ()
    stop: tuple[str, ...] = ()
    noise: tuple[str, ...] = ()
    events: tuple[str, ...] = ()
    entity_stop: tuple[str, ...] = ()
    non_answers: tuple[str, ...] = ("unknown", "none", "n/a", "null", "various", "multiple")
    generic_names: tuple[str, ...] = ("general", "generic", "various")

    @staticmethod
    def from_dict(raw: dict[str, Any]) -> DomainPack:
        """A pack of plain lists; unknown keys are an error, entries are folded where texts are."""
        known = {f.name: f for f in fields(DomainPack)}
        if unknown := set(raw) - set(known):
            raise ConfigError(f"unknown lexicons: {sorted(unknown)}")
        keep = {"non_answers", "generic_names"}
        fold_ = lambda w: fold_py(w).strip()
        out: dict[str, Any] = {}
        for k, v in raw.items():
            if isinstance(v, dict):
                out[k] = {fold_(a): b for a, b in v.items()}
            else:
                out[k] = tuple(dict.fromkeys(w if k in keep else fold_(w) for w in v))
        return DomainPack(**out)

    def collisions(self) -> dict[str, list[str]]:
        """Keys that aliases of different length classes share: worth a look, not an error."""
        by_key: dict[str, list[str]] = {}
        for alias, key in self.game_keys.items():
            by_key.setdefault(key, []).append(alias)
        return {k: v for k, v in by_key.items() if len({a.split()[0] for a in v}) > 1}


def _text(value: Any, where: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ConfigError(f"{where}: a non-empty text is asked for")
    return value.strip()


def _list(value: Any, where: str) -> list:
    if value is None:
        return []
    if not isinstance(value, list):
        raise ConfigError(f"{where}: a list is asked for")
    return value


def _map(value: Any, where: str) -> dict:
    if not isinstance(value, dict):
        raise ConfigError(f"{where}: a map is asked for")
    return value


def _count(value: Any, where: str, least: int = 0) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ConfigError(f"{where}: a whole number of at least {least} is asked for")
    return value


def _flag(value: Any, where: str) -> bool:
    if not isinstance(value, bool):
        raise ConfigError(f"{where}: true or false is asked for")
    return value


@dataclass(frozen=True)
class Rules:
    """Entities to include and to exclude, in order."""

    include: tuple[Rule, ...]
    exclude: tuple[Rule, ...]


def parse_rules(raw: Any, include: str = "include", exclude: str = "exclude") -> Rules:
    """Rules from a parsed file; the keys of both lists are parameters. A name in both lists is an error."""
    raw = _map(raw, "rules")

    def rule(entry: Any, where: str) -> Rule:
        entry = _map(entry, where)
        platforms = [_text(p, f"{where}.platform").lower() for p in _list(entry.get("platform"), f"{where}.platform")]
        if bad := [p for p in platforms if p not in PLATFORMS]:
            raise ConfigError(f"{where}.platform: unknown {bad[0]!r}")
        aliases = [_text(a, f"{where}.aliases") for a in _list(entry.get("aliases"), f"{where}.aliases")]
        logo = entry.get("logo")
        return Rule(_text(entry.get("name"), f"{where}.name"), tuple(aliases), None if logo is None else _text(logo, f"{where}.logo"), tuple(platforms))

    lists = [tuple(rule(e, f"{k}[{i}]") for i, e in enumerate(_list(raw.get(k), k))) for k in (include, exclude)]
    both = {fold_py(r.name).strip() for r in lists[0]} & {fold_py(r.name).strip() for r in lists[1]}
    if both:
        raise ConfigError(f"included and excluded: {sorted(both)}")
    return Rules(*lists)


@dataclass(frozen=True)
class Feed:
    name: str
    address: str
    language: str


@dataclass(frozen=True)
class App:
    app_id: int
    name: str


@dataclass(frozen=True)
class Limits:
    """Caps; 0 lifts that of subreddits, as null does everywhere."""

    per_feed: int = 20
    per_subreddit: int = 0
    timeout_seconds: int = 15
    per_game: int = 8
    per_game_reddit: int = 15
    window_hours: int = 24


@dataclass(frozen=True)
class Sources:
    media: tuple[Feed, ...] = ()
    steam: tuple[App, ...] = ()
    subreddits: tuple[tuple[str, str], ...] = ()
    limits: Limits = Limits()
    title_patterns: tuple[str, ...] = ()
    url_patterns: tuple[str, ...] = ()


def parse_sources(raw: Any) -> Sources:
    """Sources from a parsed file. A part that isn't enabled gives no sources; unknown keys are ignored."""
    raw = _map(raw, "sources")
    media = []
    for i, e in enumerate(_list(raw.get("media"), "media")):
        e, where = _map(e, f"media[{i}]"), f"media[{i}]"
        address, language = _text(e.get("feed"), f"{where}.feed"), _text(e.get("language"), f"{where}.language")
        if not re.match(r"(?i)https?://", address):
            raise ConfigError(f"{where}.feed: http(s) is asked for")
        if language not in ("es", "en"):
            raise ConfigError(f"{where}.language: unknown {language!r}")
        media.append(Feed(_text(e.get("name"), f"{where}.name"), address, language))
    steam, reddit = _map(raw.get("steam", {}), "steam"), _map(raw.get("reddit", {}), "reddit")
    apps = [App(_count(_map(e, "steam.games").get("app_id"), "steam.app_id", 1), _text(e.get("name"), "steam.name")) for e in _list(steam.get("games"), "steam.games")]
    subs = [(_text(_map(e, "reddit.subreddits").get("name"), "reddit.name"), _text(e.get("tag", e.get("name")), "reddit.tag")) for e in _list(reddit.get("subreddits"), "reddit.subreddits")]
    given = _map(raw.get("limits", {}), "limits")
    limits = Limits(**{f.name: _count(given[f.name], f"limits.{f.name}") for f in fields(Limits) if f.name in given})
    quality = _map(raw.get("quality", {}), "quality")
    patterns = {}
    for k in ("title_patterns", "url_patterns"):
        patterns[k] = tuple(_text(p, f"quality.{k}") for p in _list(quality.get(k), f"quality.{k}"))
        for p in patterns[k]:
            try:
                re.compile(p)
            except re.error as e:
                raise ConfigError(f"quality.{k}: {p!r}: {e}") from e
    on = lambda part, name: _flag(part.get("enabled", True), f"{name}.enabled")
    return Sources(tuple(media), tuple(apps) if on(steam, "steam") else (), tuple(subs) if on(reddit, "reddit") else (), limits, **patterns)


def load_yaml(path: str) -> Any:
    """A YAML file as plain data."""
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            return yaml.safe_load(f)
    except FileNotFoundError as e:
        raise ConfigError(f"{path}: not found") from e
    except yaml.YAMLError as e:
        raise ConfigError(f"{path}: {e}") from e
