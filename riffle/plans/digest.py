"""The whole run: sources, filters, matching, clustering, caps, enrichment, retention, publication."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.domain import DomainPack, Rules, Sources
from riffle.operators import cluster, detect, enrich, filters, joins, reports, topic, topk
from riffle.operators import store as store_
from riffle.operators.providers import Fallback
from riffle.operators.store import Store
from riffle.operators.tables import shared_dir, written
from riffle.schema import raw_reject_reason, routed
from riffle.sources.feeds import reddit_as_rumors


@dataclass(frozen=True)
class Settings:
    window_hours: float = 24
    max_stories: int = 8
    pre_slack: int = 4
    to_model: int = 60
    reddit_floor: int = 8
    max_reddit: int = 15
    published: int = 200
    generic: str = "General"
    reddit_game: str = "Reddit Rumors"


def select_items(raw: DataFrame, now: Column, sources: Sources, rules: Rules, pack: DomainPack, s: Settings = Settings()) -> tuple[dict[str, DataFrame], DataFrame, reports.Meter]:
    """(stages, rejects, meter): the stages up to the model that are written as tables (clean,
    matched, stories, capped, ranked), the invalid rows, and the counts of all stages.

    The raw rows are read once: one pass routes them into valid rows and rejects, the next
    one, over the valid rows, applies the cheap native predicates. Reddit skips exclusion
    and topic."""
    meter, spark = reports.Meter(), raw.sparkSession
    valid, rejects = routed(meter.through(raw, "raw"), raw_reject_reason(), f"{shared_dir(spark)}/intake-{uuid.uuid4().hex}")
    young = meter.through(filters.by_age(meter.through(valid, "valid"), now, s.window_hours), "young")
    clean = written(meter.through(filters.without_patterns(young, sources.title_patterns, sources.url_patterns), "clean"), "clean")
    reddit = reddit_as_rumors(clean.where("source_type = 'reddit'"), s.reddit_game)
    other = filters.without_excluded(clean.where("source_type <> 'reddit'"), rules.exclude)
    topical = written(meter.through(topic.on_topic(other, pack, detect.rescued_name(F.col("title"), pack)).unionByName(reddit), "topical"), "topical")
    matched = written(meter.through(detect.assign_games(topical, rules, pack, s.generic, s.reddit_game).withColumn("relevance", F.lit(0)), "matched"), "matched")
    stories = written(meter.through(cluster.representatives(matched.drop("match_reason"), pack), "stories"), "stories")
    capped = written(meter.through(topk.per_game(stories, s.max_stories + s.pre_slack, (s.generic,), skip_reddit=True), "capped"), "capped")
    featured = tuple(r.name for r in rules.include)
    ranked = written(meter.through(topk.with_floor(capped, topk.score(now, pack.anchors, featured), s.to_model, s.reddit_floor), "ranked"), "ranked")
    return {"clean": clean, "matched": matched, "stories": stories, "capped": capped, "ranked": ranked}, rejects, meter


def run(
    spark: SparkSession, raw: DataFrame, now: Column, sources: Sources, rules: Rules, pack: DomainPack, store: Store, make: Callable[[], Fallback], s: Settings = Settings(), seed: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(published rows, funnel report). Nothing is written if every model call failed. seed: the
    document that a store without a history begins with. Invalid rows are kept in the store."""
    stages, rejects, meter = select_items(raw, now, sources, rules, pack, s)
    old = store_.load(spark, seed)[0] if seed and store.history() is None else None
    past = [t for t in (store.published(), store.history() if old is None else old) if t is not None]
    cache = joins.build_cache(*past) if past else spark.createDataFrame([], "norm_url string, summary string, relevance int, category string, game string, language string")
    items = written(meter.through(enrich.enrich(stages["ranked"].drop("relevance"), cache, make, s.generic), "enriched"), "enriched")
    reports.guard(items)
    kept = topk.per_game_two_quotas(items, s.max_stories, s.max_reddit).drop("outcome")
    final = topk.retain(kept, now, s.window_hours, s.published)
    return store.save(final, now, s.window_hours, s.published, seed=old, rejects=rejects), meter.funnel(spark)


def report(stages: dict[str, DataFrame], meter: reports.Meter) -> dict[str, DataFrame]:
    """Of the stages of select_items: rows and first titles of each, and why names were matched."""
    return {"stages": reports.stage_report(meter, stages), "match_reasons": reports.histogram(stages["matched"], "match_reason")}


def read(store: Store, game: str | None = None, section: str = "all") -> DataFrame:
    """The reader's query over the published rows, newest first."""
    rows = store.published()
    if rows is None:
        raise FileNotFoundError(store.base)
    return topk.newest_first(filters.section(rows, game, section))
