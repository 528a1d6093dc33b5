"""Row filters. Each is a predicate that Catalyst can push down, and all but `by_age` keep null inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.domain import ConfigError, Rule
from riffle.functions.text import fold, phrase_pattern


def by_age(df: DataFrame, now: Column, hours: float, at: str = "published_at") -> DataFrame:
    """Rows at most `hours` old, the edge and the future included."""
    seconds = int(hours * 3600)
    return df.where(F.col(at) >= now - F.expr(f"INTERVAL {seconds} SECONDS"))


def without_patterns(df: DataFrame, title_patterns=(), url_patterns=()) -> DataFrame:
    """Rows whose title and url match none of the patterns, whatever their case."""
    for c, patterns in (("title", title_patterns), ("url", url_patterns)):
        if patterns:
            joined = "|".join(f"(?:{p})" for p in patterns)
            df = df.where(~F.coalesce(F.col(c).rlike(f"(?i){joined}"), F.lit(False)))
    return df


def mentions(rules: list[Rule] | tuple[Rule, ...], *texts: Column) -> Column:
    """True where the folded texts hold a name of any rule as whole words."""
    names = [n for r in rules for n in r.names]
    return F.coalesce(fold(F.concat_ws(" ", *texts)).rlike(phrase_pattern(names)), F.lit(False))


def without_excluded(df: DataFrame, rules: list[Rule] | tuple[Rule, ...]) -> DataFrame:
    """Rows whose title and body don't mention an excluded entity, whatever else they mention."""
    return df.where(~mentions(rules, F.col("title"), F.col("body_text")))


def split_reddit(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reddit, other)."""
    return df.where("source_type = 'reddit'"), df.where("source_type <> 'reddit'")


def section(df: DataFrame, game: str | None = None, name: str = "all", rumor: str = "rumor") -> DataFrame:
    """The reader's view: rows of an entity (null: all) in a section: all, news (no rumors) or rumors."""
    if game is not None:
        df = df.where(F.col("game") == game)
    if name == "news":
        df = df.where(F.col("category") != rumor)
    elif name == "rumors":
        df = df.where(F.col("category") == rumor)
    return df


def check_patterns(spark: SparkSession, *patterns: str) -> None:
    """Raise ConfigError for a pattern that Spark's regular expressions, which are Java's, don't take;
    a configuration file's reader knows Python's only."""
    for p in patterns:
        try:
            spark.range(1).select(F.concat(F.lit("a"), F.col("id").cast("string")).rlike(p)).first()
        except Exception as e:  # noqa: BLE001  whatever the engine says of the pattern
            raise ConfigError(f"pattern {p!r}: {str(e).splitlines()[0]}") from e
