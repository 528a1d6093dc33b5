"""Aggregates that describe a run: counts by class, reason and outcome, and the funnel."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .tables import written

REDDIT = "source_type = 'reddit'"


def by_class(df: DataFrame) -> DataFrame:
    """(total, reddit, media_steam)."""
    return df.agg(F.count("*").alias("total"), F.count_if(F.expr(REDDIT)).alias("reddit"), F.count_if(F.expr(f"not ({REDDIT})")).alias("media_steam"))


def _first_titles(df: DataFrame, most: int) -> DataFrame:
    """(titles): the first titles by pos, without gathering the rest."""
    return df.orderBy("pos").limit(most).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda s: s["title"]).alias("titles"))


def by_subreddit(df: DataFrame) -> DataFrame:
    return df.where(REDDIT).groupBy("source_subreddit").count()


def age_edges(df: DataFrame, limit: Column) -> DataFrame:
    """Oldest instant accepted and newest rejected at a limit."""
    at = F.col("published_at")
    return df.agg(F.min(F.when(at >= limit, at)).alias("oldest_accepted"), F.max(F.when(at < limit, at)).alias("newest_rejected"))


def histogram(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def outcomes(df: DataFrame) -> DataFrame:
    """Counts of outcome by class, an outcome a column: cache, new, fallback."""
    kinds = ["cache", "new", "fallback"]
    return df.groupBy(F.expr(REDDIT).alias("is_reddit")).pivot("outcome", kinds).count().na.fill(0, kinds)


def identification(df: DataFrame, generic: Column) -> DataFrame:
    """(identified, generic, reddit)."""
    reddit = F.expr(REDDIT)
    return df.agg(F.count_if(~generic & ~reddit).alias("identified"), F.count_if(generic & ~reddit).alias("generic"), F.count_if(reddit).alias("reddit"))


class Meter:
    """Counts rows by class as they pass, in the jobs that a run has anyway."""

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}

    def through(self, df: DataFrame, stage: str) -> DataFrame:
        """df, counted under the name of a stage. The first job that computes the whole of it
        counts; df must be used once in that job, else its rows count twice."""
        self.seen[stage] = Observation(f"{stage}-{uuid.uuid4().hex}")
        return df.observe(self.seen[stage], F.count("*").alias("total"), F.count_if(F.expr(REDDIT)).alias("reddit"))

    def counts(self) -> dict[str, tuple[int, int, int]]:
        """(total, reddit, media and stores) of each stage, in order, once its job has ended."""
        got = {name: o.get for name, o in self.seen.items()}
        return {name: (x["total"], x["reddit"], x["total"] - x["reddit"]) for name, x in got.items()}

    def funnel(self, spark: SparkSession) -> DataFrame:
        """(ord, stage, total, reddit, media_steam) of each stage."""
        rows = [(i, name, *x) for i, (name, x) in enumerate(self.counts().items())]
        return spark.createDataFrame(rows, "ord int, stage string, total long, reddit long, media_steam long")


def stage_stats(df: DataFrame, stage: str, titles: int = 10) -> DataFrame:
    """One row: stage, counts by class, and the first titles by pos; one pass over df does both."""
    meter = Meter()
    first = written(meter.through(df, stage).select("pos", "title").orderBy("pos").limit(titles), "titles")
    total, reddit, other = meter.counts()[stage]
    return _first_titles(first, titles).select(F.lit(stage).alias("stage"), *[F.lit(n).cast("long").alias(c) for c, n in (("total", total), ("reddit", reddit), ("media_steam", other))], "titles")


def stage_report(meter: Meter, stages: dict[str, DataFrame], titles: int = 10) -> DataFrame:
    """(stage, total, reddit, media_steam, titles): counts from the run's own jobs, and the first
    titles by pos of those stages, written tables, that are given."""
    counts = meter.counts()
    spark = next(iter(stages.values())).sparkSession
    rows = spark.createDataFrame([(n, *x) for n, x in counts.items()], "stage string, total long, reddit long, media_steam long")
    first = None
    for name, df in stages.items():
        part = _first_titles(df, titles).select(F.lit(name).alias("stage"), "titles")
        first = part if first is None else first.unionAll(part)
    return rows.join(first, "stage", "left")


class AllFailed(RuntimeError):
    """Every attempt to enrich failed; nothing may be written."""


def guard(df: DataFrame, least: int = 3) -> None:
    """Raise if at least `least` rows were attempted (outcome new or fallback) and none succeeded."""
    row = df.agg(F.count_if(F.col("outcome").isin("new", "fallback")).alias("tried"), F.count_if(F.col("outcome") == "new").alias("ok")).first()
    if row["tried"] >= least and not row["ok"]:
        raise AllFailed(f"{row['tried']} attempts, none succeeded")


def discards(valid: DataFrame, rejects: DataFrame, samples: int = 3) -> DataFrame:
    """(kind, n, titles) of kinds rejected and without_summary: counts, and the first titles of the
    latter; one pass over each."""
    lost = stage_stats(valid.where("summary is null"), "without_summary", samples).select(F.col("stage").alias("kind"), F.col("total").alias("n"), "titles")
    return rejects.agg(F.count("*").alias("n")).select(F.lit("rejected").alias("kind"), "n", F.array().cast("array<string>").alias("titles")).unionAll(lost)
