"""Ranking: grouped and global top-k, floors and retention.

Rank filters stay pure (rank <= k), so that Spark limits each group before it shuffles;
exempt rows and rows under another cap take a branch of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riffle.functions.dates import recency
from riffle.functions.text import title_words
from riffle.schema import is_generic

from .tables import written


def _order() -> list[Column]:
    return [F.coalesce(F.col("relevance"), F.lit(0)).desc(), F.col("published_at").desc(), F.col("pos").asc()]


def within(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("_rank") <= k).drop("_rank")


def per_game(df: DataFrame, k: int, generic: tuple[str, ...] = (), skip_reddit: bool = False) -> DataFrame:
    """The k most relevant, then newest, rows of each game; generic games, and reddit rows if
    they are to be skipped, are exempt; k <= 0 changes nothing."""
    if k <= 0:
        return df
    free = is_generic(F.col("game"), generic)
    if skip_reddit:
        free |= F.col("source_type") == "reddit"
    return within(df.where(~free), ["game"], _order(), k).unionByName(df.where(free))


def per_game_two_quotas(df: DataFrame, media: int | None, reddit: int | None) -> DataFrame:
    """Per game, so many rows of media and stores and so many of reddit; None: no cap, 0: none."""
    parts = []
    for rows, k in ((df.where("source_type <> 'reddit'"), media), (df.where("source_type = 'reddit'"), reddit)):
        parts.append(rows if k is None else within(rows, ["game"], _order(), k))
    return parts[0].unionByName(parts[1])


def score(now: Column, anchors: tuple[str, ...], featured: tuple[str, ...]) -> Column:
    """Recency over 48 hours, +2 for an anchor word in the title, +3 for a featured game, +1 unless reddit."""
    words = F.array(*[F.lit(a) for a in anchors]) if anchors else F.array().cast("array<string>")
    return (
        recency(F.col("published_at"), now)
        + F.when(F.arrays_overlap(title_words(F.col("title")), words), 2.0).otherwise(0.0)
        + F.when(F.coalesce(F.lower(F.trim("game")).isin(*[f.lower() for f in featured]), F.lit(False)), 3.0).otherwise(0.0)
        + F.when(F.col("source_type") != "reddit", 1.0).otherwise(0.0)
    )


def with_floor(df: DataFrame, points: Column, most: int = 60, floor: int = 8) -> DataFrame:
    """The `most` best rows, of which at least `floor` are reddit's if so many exist.

    One pass: both classes are cut to their `most` best, and the rest looks at those rows only.
    """
    order = [F.col("_score").desc(), F.col("published_at").desc(), F.col("url").desc(), F.col("pos").asc()]
    scored = df.withColumn("_score", points)
    is_reddit = F.col("source_type") == "reddit"
    few = written(scored.where(is_reddit).orderBy(*order).limit(most).unionByName(scored.where(~is_reddit).orderBy(*order).limit(most)), "floor")
    n, n_reddit = few.select(F.count("*"), F.count_if(is_reddit)).first()  # of 2 * most rows at most
    if n <= most:
        return few.drop("_score")
    in_top = few.orderBy(*order).limit(most).where(is_reddit).count()
    more = max(0, min(floor - in_top, n_reddit - in_top, most - in_top)) if floor > 0 else 0
    reddit = few.where(is_reddit).orderBy(*order).limit(in_top + more)
    other = few.where(~is_reddit).orderBy(*order).limit(most - in_top - more)
    return reddit.unionByName(other).drop("_score")


def retain(df: DataFrame, now: Column, max_age_hours: float | None = 48, max_total: int | None = 200, max_per_game: int | None = None, max_per_game_reddit: int | None = None) -> DataFrame:
    """Rows young enough; of media and stores the max_total newest; then the caps per game, where
    above 0. reddit doesn't count towards max_total. Order the result by published_at desc, pos."""
    if max_age_hours is not None:
        df = df.where(F.col("published_at") >= now - F.expr(f"INTERVAL {int(max_age_hours * 3600)} SECONDS"))
    media, reddit = df.where("source_type <> 'reddit'"), df.where("source_type = 'reddit'")
    if max_total is not None:
        media = media.orderBy(F.desc("published_at"), "pos").limit(max_total)
    newest = [F.col("published_at").desc(), F.col("pos").asc()]
    if max_per_game and max_per_game > 0:
        media = within(media, ["game"], newest, max_per_game)
    if max_per_game_reddit and max_per_game_reddit > 0:
        reddit = within(reddit, ["game"], newest, max_per_game_reddit)
    return media.unionByName(reddit)


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("published_at"), "pos")


def trailing_sum(df: DataFrame, value: str, at: str, seconds: int = 60, by: list[str] | None = None) -> DataFrame:
    """`spent`: the sum of value over the last seconds, the row included, within each key of `by`."""
    w = Window.partitionBy(*(by or [])).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("spent", F.sum(value).over(w))
