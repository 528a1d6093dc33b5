"""Queries with SQL for names in titles: rules, references, known titles, and the cascade that detects a name.

Titles are made of the parts' names and the documents' first sentences, by templates."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.domain import DomainPack, Rule, Rules
from riffle.functions import text
from riffle.operators import detect, mentions

from . import sqltext as S
from .items_view import items_view, table
from .queries import EXCLUDED, INCLUDED, PACK, _with, query

NAMES = DomainPack.from_dict({
    "known_titles": {"ring": "Ring", "small ring": "Small Ring", "red widget": "Red Widget", "gizmo": "Gizmo", "hot": "Hot Series", "blue bolt": "Blue Bolt"},
    "anchors": ["launches", "reveals", "gets"], "leading_noise": ["new", "the"], "generic_tokens": ["app", "studio"], "non_game": ["company"], "post_name": ["officially", "finally"], "places": ["red bolt", "small gear"],
})
#: Titles by pos % 12; A and B are names of parts, T is the document's first sentence.
TEMPLATES = (
    "New {A} launches today", "{A} finally reveals its map", "I love {A}", "A {A} clone", "This isn't {A}, {B} or others", "Why we are still playing {A}", "{A} mixes cards and dice", "{A} 6? No thanks",
    "No time, still playing {B}", "Big Studio launches app", "{A} 4 development news, better than {B}", "{T} gets {A}'s map",
)

_A, _B = "initcap(a.p_name)", "initcap(b.p_name)"


def _titles_sql() -> str:
    """CTE of titles (pos, title, name)."""
    name = lambda p: f"(upper({p}.p_name[1]) || split_part({p}.p_name, ' ', 1)[2:] || ' ' || upper(split_part({p}.p_name, ' ', 2)[1]) || split_part({p}.p_name, ' ', 2)[2:])"
    cases = []
    for i, t in enumerate(TEMPLATES):
        whole = "'" + t.replace("'", "''") + "'"
        for mark, value in (("{A}", name("a")), ("{B}", name("b")), ("{T}", "i.title")):
            whole = f"replace({whole}, '{mark}', {value})"
        cases.append(f"WHEN {i} THEN {whole}")
    return f""", titles AS (SELECT i.pos, CASE i.pos % 12 {" ".join(cases)} END AS title, CASE WHEN i.pos % 12 IN (4, 8) THEN {name("b")} ELSE {name("a")} END AS name
      FROM items i JOIN part a ON a.p_partkey = i.pos % 100 + 1 JOIN part b ON b.p_partkey = i.pos % 97 + 1)"""


def _titles(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    a = part.select((F.col("p_partkey") - 1).alias("ka"), F.initcap("p_name").alias("A"))
    b = part.select((F.col("p_partkey") - 1).alias("kb"), F.initcap("p_name").alias("B"))
    rows = items_view(spark, d).withColumns({"ka": F.col("pos") % 100, "kb": F.col("pos") % 97}).join(F.broadcast(a.where("ka < 100")), "ka").join(F.broadcast(b.where("kb < 97")), "kb")
    title = F.lit(None).cast("string")
    for i, t in enumerate(TEMPLATES):
        whole = F.lit(t)
        for mark, value in (("{A}", "A"), ("{B}", "B"), ("{T}", "title")):
            whole = F.replace(whole, F.lit(mark), F.col(value))
        title = F.when(F.col("pos") % 12 == i, whole).otherwise(title)
    return rows.select("pos", title.alias("title"), F.when((F.col("pos") % 12).isin(4, 8), F.col("B")).otherwise(F.col("A")).alias("name"))


def _is_reference_sql(w: str, start: str, end: str, pack: DomainPack) -> str:
    """Whether the mention of the words start..end (from 1, both included) of list w is a reference."""
    after, before = f"{w}[{end} + 1:]", f"{w}[greatest(1, {start} - 10):{start} - 1]"
    neg, stems, playing = S.words(pack.negations), S.words(pack.contraction_stems), S.words(pack.playing)
    suffixes, no = S.words(pack.comparison_suffixes), f"list_filter(range(1, 5), lambda i: ({after})[i] = 'no')[1]"
    n = f"len({before})"
    stem = f"list_filter(range(1, {n}), lambda i: list_contains({stems}, ({before})[i]) AND ({before})[i + 1] = 't')[1]"
    marker = f"coalesce(list_filter(range(1, {n} + 1), lambda i: list_contains({neg}, ({before})[i]))[1], {stem})"
    return f"""(coalesce(list_contains({suffixes}, ({after})[1]) OR list_contains({suffixes}, ({after})[1] || ' ' || ({after})[2]), false)
      OR list_has_any(({before})[greatest(1, {n} - 1):], {neg}) OR coalesce({n} > 1 AND list_contains({stems}, ({before})[{n} - 1]) AND ({before})[{n}] = 't', false)
      OR coalesce(NOT list_has_any(({before})[{marker} + 1:], {playing}), false)
      OR coalesce(list_contains({S.words(pack.dismissals)}, ({after})[1]), false)
      OR coalesce({no} IS NOT NULL AND (({after})[{no} + 1] IS NULL OR list_contains({S.words(pack.no_follow)}, ({after})[{no} + 1])), false))"""


def _found_sql(w: str, names) -> str:
    """Sorted list of {s, e (from 1, both included), o} of the mentions of names in list w."""
    parts = []
    for o, ws in enumerate(n.split() for n in names):
        source = w if len(ws) == 1 else f"list_zip({', '.join(f'{w}[{k + 1}:]' for k in range(len(ws)))})"
        test = f"z = '{ws[0]}'" if len(ws) == 1 else " AND ".join(f"z[{k + 1}] = '{x}'" for k, x in enumerate(ws))
        parts.append(f"list_filter(list_transform({source}, lambda z, i: CASE WHEN {test} THEN {{'s': i, 'o': {o}, 'e': i + {len(ws) - 1}}} END), lambda m: m IS NOT NULL)")
    return "list_sort(" + (parts[0] if len(parts) == 1 else f"flatten([{', '.join(parts)}])") + ")"


def _list(x: str) -> str:
    return f"list_filter(string_split(trim({S.fold(x)}), ' '), lambda x: x <> '')"


@query(_with(f"""{_titles_sql()}, w AS (SELECT pos, {_list("title")} AS w, string_split(trim({S.fold("name")}), ' ') AS n FROM titles),
  f AS (SELECT pos, w, len(n) AS len_n, list_filter(range(1, len(w) - len(n) + 2), lambda i: w[i:i + len(n) - 1] = n)[1] AS spot FROM w)
  SELECT pos, spot IS NOT NULL AND {_is_reference_sql("w", "spot", "(spot + len_n - 1)", PACK)} AS is_reference FROM f"""))
def reference_guard(spark: SparkSession, d: str) -> DataFrame:
    """Whether each title only compares, negates or dismisses the name of its part."""

    @F.pandas_udf("boolean")
    def guard(titles: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([detect.is_reference(t, n, PACK) for t, n in zip(titles, names)])

    return _titles(spark, d).select("pos", guard("title", "name").alias("is_reference"))


_EDGE = detect._EDGE.replace("'", "''")


def _tokens_sql(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex(replace({x}, '’', ''''), '\\s+'), lambda t: trim(t, '{_EDGE}')), lambda t: t <> '')"


_KNOWN = list(NAMES.known_titles.items())
#: Known titles of a list of words, the longest alias first: {n: -length, i: its number, s, e}.
_KNOWN_AT = "list_sort(list_filter([" + ", ".join(f"{{'n': -{len(a)}, 'i': {i}, 's': {_found_sql('w', [a])}[1].s, 'e': {_found_sql('w', [a])}[1].e}}" for i, (a, _) in enumerate(_KNOWN)) + "], lambda k: k.s IS NOT NULL))"
_CANONICAL = f"({S.words([c for _, c in _KNOWN])})"
_BANNED = S.words([*NAMES.generic_tokens, *NAMES.non_game])


@query(_with(f"""{_titles_sql()}, w AS (SELECT pos, {_list("title")} AS w FROM titles), k AS (SELECT pos, w, {_KNOWN_AT} AS k FROM w)
  SELECT pos, array_to_string(list_transform(k, lambda x: {_CANONICAL}[x.i + 1]), '|') AS mentioned, array_to_string(list_transform(list_filter(k, lambda x: NOT {_is_reference_sql("w", "x.s", "x.e", NAMES)}), lambda x: {_CANONICAL}[x.i + 1]), '|') AS named FROM k"""))
def known_names(spark: SparkSession, d: str) -> DataFrame:
    """Known titles in each title, the longest first; then without those that are references."""
    names = detect.Matcher(None, NAMES)

    @F.pandas_udf("mentioned string, named string")
    def found(titles: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([("|".join(names.known(t, False)), "|".join(names.known(t))) for t in titles], columns=["mentioned", "named"])

    return _titles(spark, d).select("pos", found("title").alias("m")).select("pos", "m.mentioned", "m.named")


_CAPITAL = "(upper({p}[1]) = {p}[1] AND lower({p}[1]) <> {p}[1] OR {p}[1] BETWEEN '0' AND '9')"
_LOW_KNOWN = " OR ".join(f"contains(' ' || name_words || ' ', ' {a} ')" for a, _ in _KNOWN)


@query(_with(f"""{_titles_sql()},
  t AS (SELECT pos, title, {_list("title")} AS w, {_tokens_sql("title")} AS tok FROM titles),
  l AS (SELECT *, list_transform(tok, lambda x: replace({S.fold("x")}, ' ', '')) AS low, {_KNOWN_AT} AS k FROM t),
  g AS (SELECT *, {_CANONICAL}[list_filter(k, lambda x: NOT {_is_reference_sql("w", "x.s", "x.e", NAMES)})[1].i + 1] AS known FROM l),
  a AS (SELECT pos, tok, low, unnest(list_filter(range(1, len(tok) + 1), lambda i: list_contains({S.words(NAMES.anchors)}, low[i]))) AS spot FROM g),
  b AS (SELECT *, list_filter(range(1, spot), lambda j: NOT list_contains({S.words(NAMES.leading_noise)}, low[j]))[1] AS x FROM a),
  c AS (SELECT *, list_filter(range(x, spot), lambda j: NOT list_contains({S.words(NAMES.post_name)}, low[j])) AS in_ FROM b WHERE x IS NOT NULL),
  e AS (SELECT *, in_[len(in_)] AS y FROM c WHERE len(in_) > 0),
  f AS (SELECT pos, spot, list_transform(range(x, least(y, x + 5) + 1), lambda j: CASE WHEN j = least(y, x + 5) THEN regexp_replace(tok[j], '''s$', '') ELSE tok[j] END) AS part FROM e WHERE NOT list_has_any(low[x:y], {_BANNED})),
  h AS (SELECT *, array_to_string(part, ' ') AS name, trim({S.fold("array_to_string(part, ' ')")}) AS name_words FROM f),
  o AS (SELECT pos, arg_min(name, (CASE WHEN {_LOW_KNOWN} THEN 0 ELSE 1 END, len(part), spot)) AS raw_anchor FROM h WHERE len(name) >= 2 GROUP BY pos),
  n AS (SELECT g.*, raw_anchor, CASE WHEN regexp_matches(raw_anchor, '^\\pL') AND len(string_split(raw_anchor, ' ')) >= 2 AND NOT list_contains({S.words(NAMES.places)}, trim({S.fold("raw_anchor")})) THEN raw_anchor END AS anchor FROM g LEFT JOIN o USING (pos)),
  s AS (SELECT *, list_filter(list_transform(flatten(list_transform(list_filter(range(1, len(tok) + 1), lambda i: list_contains({S.words((*NAMES.contrast_verbs, "isn''t", "aren''t", "wasn''t"))}, lower(tok[i]))), lambda i: [tok[greatest(1, i - 3):i - 1], tok[greatest(1, i - 2):i - 1], tok[greatest(1, i - 1):i - 1]])), lambda p: p),
      lambda p: len(p) > 0 AND len(list_filter(p, lambda q: NOT {_CAPITAL.format(p="q")})) = 0 AND NOT list_contains({S.words(NAMES.pronouns)}, trim({S.fold("p[1]")})))[1] AS subject,
    trim(regexp_extract(title, '\\b(?:playing|played)\\s+((?:[A-Z0-9][\\w'':-]*\\s*)+)', 1), '{_EDGE} ') AS played FROM n)
  SELECT pos, CASE WHEN anchor IS NOT NULL AND known IS NOT NULL AND NOT starts_with(trim({S.fold("anchor")}), trim({S.fold("known")})) THEN known WHEN anchor IS NOT NULL THEN anchor WHEN known IS NOT NULL THEN known
      WHEN subject IS NOT NULL THEN array_to_string(subject, ' ') WHEN played <> '' AND NOT list_contains({S.words(NAMES.pronouns)}, trim({S.fold("played")})) THEN played END AS name,
    CASE WHEN anchor IS NOT NULL AND known IS NOT NULL AND NOT starts_with(trim({S.fold("anchor")}), trim({S.fold("known")})) THEN 'known' WHEN anchor IS NOT NULL THEN 'anchor' WHEN known IS NOT NULL THEN 'known'
      WHEN subject IS NOT NULL THEN 'subject' WHEN played <> '' AND NOT list_contains({S.words(NAMES.pronouns)}, trim({S.fold("played")})) THEN 'playing' ELSE 'none' END AS reason,
    raw_anchor IS NOT NULL AND len(string_split(raw_anchor, ' ')) <= 5 AND len(list_filter(string_split(raw_anchor, ' '), lambda x: NOT list_contains({S.words((*NAMES.generic_tokens, *NAMES.non_game, *NAMES.places))}, replace({S.fold("x")}, ' ', '')))) > 0 AS rescued FROM s"""))
def detection(spark: SparkSession, d: str) -> DataFrame:
    """The name that the cascade finds in each title, why, and whether an anchor rescues the title."""
    names = detect.Matcher(None, NAMES)

    @F.pandas_udf("name string, reason string, rescued boolean")
    def found(titles: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(*detect.detect(t, NAMES, None, names), detect.rescued(t, NAMES, names)) for t in titles], columns=["name", "reason", "rescued"])

    return _titles(spark, d).select("pos", found("title").alias("m")).select("pos", "m.name", "m.reason", "m.rescued")


#: Rules over words of the documents; the guard's words are some that titles hold.
GUARDED = replace(PACK, negations=("der", "la", "of"), playing=("that",), dismissals=("les",), comparison_suffixes=("le", "and"), no_follow=("the",))
RULES = Rules((*INCLUDED, Rule("The", ("the", "a"))), EXCLUDED)
_NUMBERED = "concat(title, CASE WHEN pos % 3 = 0 THEN ' und 6 la' WHEN pos % 3 = 1 THEN ' of los 2 3 no the' ELSE ' und 7' END)"
_INCLUDE = [[n.lower() for n in r.names] for r in RULES.include]
_EXCLUDE = [n.lower() for r in RULES.exclude for n in r.names]
_SEPARATE = "list_reduce(list_concat([{'s': 0::BIGINT, 'o': 0, 'e': 0::BIGINT}], m.all_b), lambda x, y: CASE WHEN y.s > x.e THEN {'s': x.s, 'o': x.o + 1, 'e': y.e} ELSE x END).o"


def _rule_columns() -> str:
    out = []
    for i, names in enumerate(_INCLUDE):
        out += [f"{_found_sql('w', names)}[1] AS t{i}", f"{_found_sql('b', names)} AS b{i}"]
    return ", ".join(out)


def _only_context(i: int) -> str:
    digits = f"CASE WHEN regexp_full_match(coalesce(w[t{i}.e + 1], ''), '[0-9]+') THEN CASE WHEN regexp_full_match(coalesce(w[t{i}.e + 2], ''), '[0-9]+') THEN 2 ELSE 1 END ELSE 0 END"
    return _is_reference_sql("w", f"t{i}.s", f"(t{i}.e + {digits})", GUARDED)


def _topic(i: int) -> str:
    return f"(t{i} IS NOT NULL AND NOT c{i} OR {_SEPARATE.replace('m.all_b', f'b{i}')} >= 2)"


@query(_with(f""", w AS (SELECT pos, {_list(_NUMBERED)} AS w, {_list("body_text")} AS b FROM items),
  f AS (SELECT pos, w, b, len({_found_sql("list_concat(w, b)", _EXCLUDE)}) > 0 AS excluded, {_rule_columns()} FROM w),
  c AS (SELECT *, {", ".join(f"t{i} IS NOT NULL AND {_only_context(i)} AS c{i}" for i in range(len(_INCLUDE)))} FROM f)
  SELECT pos, CASE WHEN excluded THEN NULL {" ".join(f"WHEN {_topic(i)} THEN '{r.name}'" for i, r in enumerate(RULES.include))} END AS rule,
    array_to_string(list_filter([{", ".join(f"CASE WHEN c{i} THEN '{r.name}' END" for i, r in enumerate(RULES.include))}], lambda x: x IS NOT NULL), '|') AS context FROM c"""))
def rule_match(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that is each item's main topic, its names followed by numbers or not, and those that are context only."""
    names = detect.Matcher(RULES, GUARDED)

    @F.pandas_udf("rule string, context string")
    def found(titles: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(names.rule(t, b), "|".join(names.context(t))) for t, b in zip(titles, bodies)], columns=["rule", "context"])

    p = F.col("pos") % 3
    title = F.concat("title", F.when(p == 0, " und 6 la").when(p == 1, " of los 2 3 no the").otherwise(" und 7"))
    return items_view(spark, d).select("pos", found(title, text.fold(F.col("body_text"))).alias("m")).select("pos", "m.rule", "m.context")


PHRASES = ("that with", "in the", "the", "the that", "de la", "la")


@query(f"""WITH w AS (SELECT doc_id, {_list("text")} AS w FROM documents), m AS (SELECT doc_id, unnest({_found_sql("w", PHRASES)}) AS m FROM w)
  SELECT doc_id, ({S.words(PHRASES)})[m.o + 1] AS term, CAST(m.s - 1 AS INT) AS "start", CAST(m.e AS INT) AS "end" FROM m""")
def mention_places(spark: SparkSession, d: str) -> DataFrame:
    """Every mention of some phrases in the whole documents, with its place in words."""
    terms = spark.createDataFrame([(t,) for t in PHRASES], "term string")
    return mentions.mentions(table(spark, d, "documents"), "doc_id", F.col("text"), terms)
