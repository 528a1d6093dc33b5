"""SQL for the text and address functions, to hold the Column expressions against."""

from __future__ import annotations

from riffle.functions.urls import TRACKING


def words(ws) -> str:
    return "[" + ", ".join(f"'{w}'" for w in ws) + "]::VARCHAR[]"


def fold(x: str) -> str:
    return f"regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g')"


def normal_title(x: str) -> str:
    return f"trim({fold(f'''regexp_replace({x}, '[''’‘`]', '', 'g')''')})"


def title_words(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({normal_title(x)}, ' '), lambda w: w <> '')))"


def keywords(x: str, stop, noise, events, most: int = 10) -> str:
    ws = f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-záéíóúñü0-9]+'), lambda w: len(w) > 2 AND NOT list_contains({words([*stop, *noise])}, w)))"
    ev = words(events)
    return f"list_concat(list_sort(list_filter({ws}, lambda w: list_contains({ev}, w))), list_sort(list_filter({ws}, lambda w: NOT list_contains({ev}, w))))[1:{most}]"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {both} = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / {both} END"


def entities(title: str, body: str, game: str, stop) -> str:
    both = f"({title} || ' ' || {body})"
    own = f"string_split(trim({fold(game)}), ' ')"
    acronyms = f"list_filter(string_split_regex({both}, '[^A-Za-z0-9]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,5}}'))"
    runs = f"regexp_extract_all({title}, '[A-Z][a-z]+(?: [A-Z][a-z]+)*')"
    names = f"list_filter(list_transform(list_concat({acronyms}, {runs}), lambda w: trim({fold('w')})), lambda w: NOT list_contains({words(stop)}, w) AND len(list_filter(string_split(w, ' '), lambda z: NOT list_contains({own}, z))) > 0)"
    return f"list_sort(list_distinct(list_concat(regexp_extract_all({both}, '[0-9]+(?:\\.[0-9]+)*'), {names})))"


def normal_url(x: str) -> str:
    whole = f"regexp_replace(trim({x}), '#.*$', '')"
    path = f"regexp_replace(regexp_replace({whole}, '\\?.*$', ''), '/+$', '')"
    head = f"regexp_extract({path}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)"
    key = "lower(split_part(p, '=', 1))"
    kept = f"list_filter(string_split(regexp_extract({whole}, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT list_contains({words(TRACKING)}, {key}) AND NOT starts_with({key}, 'utm_'))"
    return f"(lower({head}) || substr({path}, len({head}) + 1) || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END)"


def stable_id(x: str) -> str:
    return f"substr(sha256({normal_url(x)}), 1, 16)"


def mention(x: str, names) -> str:
    """Whether the folded text holds a name as whole words."""
    return "(" + " OR ".join(f"contains(' ' || trim({fold(x)}) || ' ', ' {n} ')" for n in names) + ")"
