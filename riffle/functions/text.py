"""Text functions as Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Characters that are an ASCII one with marks, and that one, by Unicode decomposition; then
    the marks themselves, which have no counterpart and go."""
    pairs, marks = [], []
    for ch in map(chr, range(0x80, 0x20000)):
        plain = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
        if len(plain) == 1 and plain.isascii():
            pairs.append((ch, plain))
        elif not plain:
            marks.append(ch)
    return "".join(p[0] for p in pairs) + "".join(marks), "".join(p[1] for p in pairs)


ACCENTED, PLAIN = _accents()


def strip_marks(c: Column) -> Column:
    """Without accents, composed or as marks of their own."""
    return F.translate(c, ACCENTED, PLAIN)


def fold(c: Column) -> Column:
    """Lower case without accents, everything but a-z and 0-9 as one space; not trimmed."""
    return F.regexp_replace(F.lower(strip_marks(c)), "[^a-z0-9]+", " ")


def normal_title(c: Column) -> Column:
    """Like fold, but apostrophes are deleted and the result is trimmed."""
    return F.trim(fold(F.regexp_replace(c, "['’‘`]", "")))


def literal(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def keywords(c: Column, stop, noise, events, most: int = 10) -> Column:
    """Distinct words over two letters without stop and noise words; event words first, each part sorted; the first `most`."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-záéíóúñü0-9]+"), F.lit(0)), lambda w: F.length(w) > 2))
    words = F.array_except(words, literal([*stop, *noise]))
    first = F.array_sort(F.array_intersect(words, literal(events)))
    return F.slice(F.concat(first, F.array_sort(F.array_except(words, literal(events)))), 1, most)


def entities(title: Column, body: Column, game: Column, stop) -> Column:
    """Numbers and versions, upper-case acronyms (of title and body) and capitalised runs (of the title),
    folded, without stop words and names made of the game's words only."""
    both = F.concat_ws(" ", title, body)
    numbers = F.regexp_extract_all(both, F.lit(r"[0-9]+(?:\.[0-9]+)*"), F.lit(0))
    acronyms = F.filter(F.split(both, "[^A-Za-z0-9]+"), lambda w: w.rlike("^[A-Z]{2,5}$"))
    runs = F.regexp_extract_all(title, F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+)*"), F.lit(0))
    names = F.transform(F.concat(acronyms, runs), lambda w: F.trim(fold(w)))
    own = F.split(F.trim(fold(game)), " ")
    names = F.filter(F.array_except(names, literal(stop)), lambda w: F.size(F.array_except(F.split(w, " "), own)) > 0)
    return F.array_sort(F.array_distinct(F.concat(numbers, names)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def title_words(title: Column) -> Column:
    """Distinct words of the normal title, sorted; none of an empty title."""
    return F.array_sort(F.array_distinct(F.filter(F.split(normal_title(title), " "), lambda w: w != "")))


def word_overlap(a: Column, b: Column) -> Column:
    return jaccard(title_words(a), title_words(b))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end; trim takes blanks alone."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strip_possessive(c: Column) -> Column:
    return F.regexp_replace(c, "['’]s$", "")


def strip_punct(c: Column) -> Column:
    """Without punctuation at either end."""
    return F.regexp_replace(c, r"^[\p{Punct}«»“”‘’¡¿…]+|[\p{Punct}«»“”‘’¡¿…]+$", "")


def words_of(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def clean_name(c: Column, non_answers, most_chars: int = 48, most_words: int = 6) -> Column:
    """A short entity name as a model gave it; '' if it is too long or no answer."""
    name = F.trim(strip_punct(F.trim(F.regexp_replace(c, r"\s+", " "))))
    bad = (F.length(name) > most_chars) | (F.size(F.split(name, " ")) > most_words) | F.lower(name).isin(*non_answers)
    return F.when(name.isNull() | bad, F.lit("")).otherwise(name)


def excerpt(c: Column, most: int = 300) -> Column:
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(text == "", F.lit("(empty)")).when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def truncate(c: Column, most: int, mark: str = "") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def strip_reasoning(c: Column) -> Column:
    """A model's answer without think blocks, closed or not, channel prefixes and code fences."""
    c = F.regexp_replace(c, r"(?s)^.*?<\|channel\|>final<\|message\|>", "")
    c = F.regexp_replace(c, r"(?is)<think>.*?</think>", "")
    c = F.regexp_replace(c, r"(?is)<think>.*$", "")
    return strip(F.regexp_replace(c, r"(?i)```(?:json)?", ""))


def subreddit_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?:^|\s)r/([A-Za-z0-9_]+)", 1), F.lit(""))


def fix_interpunct(c: Column) -> Column:
    return F.replace(c, F.lit("┬À"), F.lit("·"))


def escape_html(c: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many))


def initials(c: Column) -> Column:
    """Up to three letters for a source: of a single word its first three, else one of each of three words."""
    words = words_of(F.regexp_replace(c, " · .*$", ""))
    return F.upper(F.when(F.size(words) == 1, F.substring(words[0], 1, 3)).otherwise(F.array_join(F.transform(F.slice(words, 1, 3), lambda w: F.substring(w, 1, 1)), "")))


def age_label(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0)).cast("long")
    return F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s % 3600 / 60))


def token_estimate(prompt: Column, reply: int = 320) -> Column:
    return (F.floor(F.length(prompt) / 3) + reply).cast("long")


def phrase_pattern(names) -> str:
    """A regular expression, for folded text, of any of the names as whole words."""
    parts = dict.fromkeys(p for p in (fold_py(n).strip() for n in names) if p)
    return r"\b(?:" + "|".join(re.escape(p) for p in parts) + r")\b" if parts else r"(?!)"


def fold_py(text: str) -> str:
    """fold() for lexicon entries on the driver, and for titles in tasks."""
    plain = text if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return re.sub("[^a-z0-9]+", " ", plain.lower())


def alias_key(game: Column, aliases: dict[str, str]) -> Column:
    """Key of the longest alias that the folded name holds as whole words (first given on a tie), else the name itself, lower and trimmed."""
    hits = [
        F.when(F.concat(F.lit(" "), F.trim(fold(game)), F.lit(" ")).contains(f" {fold_py(a).strip()} "), F.struct(F.lit(len(a)).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")))
        for i, (a, k) in enumerate(aliases.items())
    ]
    own = F.lower(F.trim(game))
    return F.coalesce(F.array_max(F.array_compact(F.array(*hits)))["k"], own) if hits else own
