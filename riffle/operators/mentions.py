"""Mentions of many phrases in many texts: one automaton over words, one pass over each text.

The folded words of all phrases make a trie whose nodes know where to go on when a word
doesn't fit (failure links), so a text is read once whatever the number of phrases, and
every mention comes with its place. The automaton is built on the driver from a lexicon
whose size is checked, and broadcast; no text is shuffled.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riffle.functions.text import fold, fold_py

#: Phrases that are broadcast at most; a larger lexicon is joined.
MOST_PHRASES = 500_000

Mention = tuple[int, int, int]


class Automaton:
    """Finds phrases (given as folded text; an empty one is nowhere) in lists of words."""

    def __init__(self, phrases: Sequence[str]):
        self.code: dict[str, int] = {}
        self.length = [len(p.split()) for p in phrases]
        self.step: list[dict[int, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for number, phrase in enumerate(phrases):
            node = 0
            for word in phrase.split():
                c = self.code.setdefault(word, len(self.code))
                if c not in self.step[node]:
                    self.step[node][c] = len(self.step)
                    self.step.append({})
                    self.ends.append([])
                node = self.step[node][c]
            if node:
                self.ends[node].append(number)
        self.back = [0] * len(self.step)
        todo = deque(self.step[0].values())
        while todo:
            node = todo.popleft()
            for c, child in self.step[node].items():
                at = self.back[node]
                while at and c not in self.step[at]:
                    at = self.back[at]
                self.back[child] = self.step[at].get(c, 0)
                # Shorter phrases that end here too; their node is nearer the root, so it is complete.
                self.ends[child] = self.ends[child] + self.ends[self.back[child]]
                todo.append(child)

    def find(self, words: Iterable[str]) -> Iterator[Mention]:
        """(start, end, number) of every mention, overlapping ones too, by end."""
        step, back, ends, get = self.step, self.back, self.ends, self.code.get
        node = 0
        for i, word in enumerate(words, 1):
            c = get(word)
            if c is None:
                node = 0
                continue
            while node and c not in step[node]:
                node = back[node]
            node = step[node].get(c, 0)
            for number in ends[node]:
                yield i - self.length[number], i, number


def first(mentions: Iterable[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The leftmost of mentions (start, end, order); of one place that of least order."""
    return min(mentions, key=lambda m: (m[0], m[2]), default=None)


def separate(mentions: Iterable[tuple[int, int, int]]) -> int:
    """How many mentions there are from left to right without overlaps, each place taking that of least order."""
    count, at = 0, 0
    for start, end, _ in sorted(mentions, key=lambda m: (m[0], m[2])):
        if start >= at:
            count, at = count + 1, end
    return count


def _lexicon(terms: DataFrame) -> list[tuple[str, str]] | None:
    """(term, folded term) of the distinct terms, or None where they are too many to broadcast."""
    rows = terms.select("term", F.trim(fold(F.col("term"))).alias("gram")).where("gram <> ''").distinct().limit(MOST_PHRASES + 1).collect()
    return None if len(rows) > MOST_PHRASES else sorted((r["term"], r["gram"]) for r in rows)


def mentions(df: DataFrame, key: str, text: Column, terms: DataFrame) -> DataFrame:
    """(key, term, start, end) of every mention in the folded text of the terms (column
    `term`), places in words, end exclusive. Null texts, and terms without a letter or
    digit, have none; equal terms count once. More terms than MOST_PHRASES raise ValueError."""
    lexicon = _lexicon(terms)
    if lexicon is None:
        raise ValueError(f"more than {MOST_PHRASES} terms")
    return _mapped(df, key, text, lexicon, places=True)


def _mapped(df: DataFrame, key: str, text: Column, lexicon: list[tuple[str, str]], places: bool) -> DataFrame:
    names, grams = [t for t, _ in lexicon], [g for _, g in lexicon]
    shared = df.sparkSession.sparkContext.broadcast((names, Automaton(grams)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, found = shared.value
        for b in batches:
            rows, at = [], []
            for i, t in enumerate(b.column(1)):
                hits = found.find((t.as_py() or "").split())
                hits = list(hits) if places else list(dict.fromkeys((0, 0, n) for _, _, n in hits))
                rows += hits
                at += [i] * len(hits)
            cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array([names[n] for *_, n in rows], pa.string())]
            if places:
                cols += [pa.array([m[0] for m in rows], pa.int32()), pa.array([m[1] for m in rows], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema])

    more = [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())] if places else []
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("term", T.StringType()), *more])
    return df.select(key, fold(text).alias("_text")).mapInArrow(run, schema)


def dictionary_matches(df: DataFrame, key: str, text: Column, terms: DataFrame) -> DataFrame:
    """(key, term) for every term (column `term`) that the folded text holds as whole words,
    once for each row. Beyond MOST_PHRASES terms, candidates are joined by their first word."""
    lexicon = _lexicon(terms)
    return joined_matches(df, key, text, terms) if lexicon is None else _mapped(df, key, text, lexicon, places=False)


def joined_matches(df: DataFrame, key: str, text: Column, terms: DataFrame) -> DataFrame:
    """The same for a lexicon of any size; key is unique in df. A term can only be where its
    first word is: the texts' distinct words find the few candidates, which are then looked
    for in full."""
    words = F.filter(F.split(fold(text), " "), lambda w: w != "")
    t = terms.select("term", F.trim(fold(F.col("term"))).alias("_gram")).where("_gram <> ''").distinct()
    found = df.select(key, F.array_distinct(words).alias("_w")).select(key, F.explode("_w").alias("_first"))
    near = found.join(t.withColumn("_first", F.substring_index("_gram", " ", 1)), "_first").groupBy(key).agg(F.collect_set(F.struct("term", "_gram")).alias("_terms"))
    whole = df.select(key, F.concat(F.lit(" "), F.trim(fold(text)), F.lit(" ")).alias("_text"))
    held = whole.join(near, key).select(key, "_text", F.explode("_terms").alias("_t"))
    return held.where(F.col("_text").contains(F.concat(F.lit(" "), F.col("_t._gram"), F.lit(" ")))).select(key, F.col("_t.term").alias("term")).distinct()


def first_rule(rules: Sequence, *texts: Column) -> Column:
    """Name of the first rule, in their order, that the folded texts mention; null if none."""
    names = [(i, fold_py(n).strip()) for i, r in enumerate(rules) for n in r.names]
    found, of, titles = Automaton([n for _, n in names]), [i for i, _ in names], [r.name for r in rules]

    @F.pandas_udf("string")
    def matched(folded: pd.Series) -> pd.Series:
        best = (min((of[n] for *_, n in found.find(t.split())), default=None) for t in folded.fillna(""))
        return pd.Series([None if i is None else titles[i] for i in best], dtype=object)

    return matched(fold(F.concat_ws(" ", *texts))) if names else F.lit(None).cast("string")
