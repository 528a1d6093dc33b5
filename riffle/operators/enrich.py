"""Model enrichment: cache first, each miss once, failures kept to their row.

The providers are in providers.py, the tasks that ask them in asking.py; raw answers are
parsed and checked here, with Columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.functions.markup import model_object
from riffle.functions.text import clean_name, strip_reasoning
from riffle.functions.urls import stable_id
from riffle.schema import CATEGORIES, ITEMS, LANGUAGES, in_enum

from .asking import call_model
from .joins import cache_misses, with_cache
from .providers import INSTRUCTION, Fallback
from .tables import written

ANSWER = "summary string, relevance string, category string, language string, game string"


def validated(df: DataFrame, non_answers: tuple[str, ...] = ("unknown", "none", "n/a")) -> DataFrame:
    """(pos, ai struct, ai_reason) from (pos, raw, source_type): ai is null where ai_reason says why.

    relevance may be a number in a string; reddit needs no category, it is always rumor."""
    obj = df.withColumn("_json", model_object(strip_reasoning(F.col("raw")))).withColumn("_o", F.from_json("_json", ANSWER))
    o = F.col("_o")
    rel = F.try_to_number(F.when(F.trim(o["relevance"]).rlike("^[0-9]+$"), F.trim(o["relevance"])), F.lit("999999")).cast("int")
    category = F.when(F.col("source_type") == "reddit", "rumor").otherwise(o["category"])
    reason = (
        F.when(F.col("raw").isNull(), "no_answer")
        .when(F.col("_json").isNull(), "no_json")
        .when(F.coalesce(F.trim(o["summary"]), F.lit("")) == "", "summary_missing")
        .when(~F.coalesce(rel.between(1, 5), F.lit(False)), "relevance_invalid")
        .when(~in_enum(category, CATEGORIES), "category_invalid")
        .when(~in_enum(o["language"], LANGUAGES), "language_invalid")
    )
    ai = F.struct(F.trim(o["summary"]).alias("summary"), rel.alias("relevance"), F.trim(category).alias("category"), F.trim(o["language"]).alias("language"), clean_name(o["game"], non_answers).alias("game"))
    return obj.withColumn("ai_reason", reason).select("pos", F.when(F.col("ai_reason").isNull(), ai).alias("ai"), "ai_reason")


def final_game(matched: Column, ai_game: Column, generic: str) -> tuple[Column, Column]:
    """(name, origin): the matched name unless generic or empty, then the model's, then generic."""
    found = F.coalesce(F.trim(matched), F.lit(""))
    certain = (found != "") & (found != generic)
    named = F.coalesce(ai_game, F.lit("")) != ""
    return F.when(certain, found).when(named, ai_game).otherwise(F.lit(generic)), F.when(certain, "matcher").when(named, "ai").otherwise("generico")


def enriched(df: DataFrame, generic: str) -> DataFrame:
    """Items (ITEMS, pos, outcome) from raw items with ai: the safe fallback where ai is null, reddit always an unverified rumor."""
    reddit = F.col("source_type") == "reddit"
    name, origin = final_game(F.col("game"), F.col("ai.game"), generic)
    cols = {
        "id": stable_id(F.col("url")), "summary": F.col("ai.summary"), "game": name, "game_origin": origin, "language": F.coalesce("language", F.lit("en")),
        "relevance": F.coalesce("ai.relevance", F.lit(1)), "category": F.when(reddit, "rumor").otherwise(F.coalesce("ai.category", F.lit("rumor"))),
        "image": F.col("image_url"), "is_verified": ~reddit, "summary_is_fallback": F.col("ai").isNull(),
    }
    return df.select("pos", *[cols.get(n, F.col(n)).alias(n) for n in ITEMS.fieldNames()], "outcome")


def enrich(df: DataFrame, cache: DataFrame, make: Callable[[], Fallback], generic: str = "General", tasks: int = 4) -> DataFrame:
    """All rows of df as items: cached answers are reused, every miss asks the model once, by `tasks` tasks."""
    hits = with_cache(df, cache).where("hit")
    known = hits.select(*df.columns, F.struct(*[F.col(f"ai_{c}").alias(c) for c in ("summary", "relevance", "category", "language", "game")]).alias("ai"), F.lit("cache").alias("outcome"))
    misses = cache_misses(df, cache)
    raw = written(call_model(misses, make, tasks), "model-answers")
    got = written(validated(raw.join(misses.select("pos", "source_type"), "pos")), "model-valid")
    fresh = misses.join(got.select("pos", "ai"), "pos").withColumn("outcome", F.when(F.col("ai").isNull(), "fallback").otherwise("new"))
    return enriched(known.unionByName(fresh.select(known.columns)), generic)


def prompt(title: Column, body: Column, game: Column, most: int = 800) -> Column:
    """The instruction that a provider sends for a row, its body cut."""
    return F.format_string(
        INSTRUCTION.replace("{categories}", ", ".join(CATEGORIES)).replace("{game}", "%s").replace("{title}", "%s").replace("{text}", "%s"),
        F.coalesce(game, F.lit("")), F.coalesce(title, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, most),
    )
