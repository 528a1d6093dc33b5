"""The scheduled job: configuration, landing of feeds, the run, the games' file."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle import domain
from riffle.operators.filters import check_patterns
from riffle.operators.providers import Extractive, Fallback
from riffle.operators.store import Store, write_games
from riffle.sources.feeds import Landed, read_all
from riffle.sources.web import HttpSource

from . import digest


@dataclass(frozen=True)
class Addresses:
    """Where stores and communities publish; {} are filled from the configuration."""

    steam: str = "https://api.steampowered.com/ISteamNews/GetNewsForApp/v2/?appid={app_id}&count={count}&maxlength=1200"
    reddit: str = "https://www.reddit.com/r/{name}/new/.rss"


def slug(text: str) -> str:
    return re.sub("[^a-z0-9]+", "-", text.lower()).strip("-")


def plan_feeds(sources: domain.Sources, folder: str, at: Addresses = Addresses()) -> list[tuple[str, Landed]]:
    """(address, landed feed) of every source, in the order media, stores, reddit."""
    lim, out = sources.limits, []
    for f in sources.media:
        out.append((f.address, Landed(f"{folder}/feed={slug('m ' + f.name)}", f.name, "media", f.language, limit=lim.per_feed or None)))
    for a in sources.steam:
        out.append((at.steam.format(app_id=a.app_id, count=lim.per_feed), Landed(f"{folder}/feed={slug(f's {a.app_id}')}", a.name, "steam", app_id=a.app_id, limit=lim.per_feed or None)))
    for name, _ in sources.subreddits:
        out.append((at.reddit.format(name=name), Landed(f"{folder}/feed={slug('r ' + name)}", f"r/{name}", "reddit", subreddit=name, limit=lim.per_subreddit or None)))
    return out


def land(spark: SparkSession, feeds: list[tuple[str, Landed]], folder: str, timeout: int = 15) -> DataFrame:
    """Fetch all addresses on the executors and write each answer into its feed's folder; (url, status) of each."""
    spark.dataSource.register(HttpSource)
    name = spark.createDataFrame([(u, x.path.rsplit("feed=", 1)[1]) for u, x in feeds], "url string, feed string")
    got = spark.read.format("riffle_http").option("urls", " ".join(u for u, _ in feeds)).option("timeout", str(timeout)).load()
    rows = got.join(name, "url")
    text = F.when(F.col("status") == 200, F.try_validate_utf8(F.col("body").cast("string"))).alias("value")
    # Each answer is one line of text: feeds end up whole in a file of their own.
    rows.select(F.regexp_replace(text, "[\r\n]+", " ").alias("value"), "feed").where("value is not null").write.mode("overwrite").partitionBy("feed").text(folder)
    return got.select("url", "status")


@dataclass(frozen=True)
class Config:
    sources: domain.Sources
    rules: domain.Rules
    pack: domain.DomainPack

    @staticmethod
    def load(sources: str, rules: str, pack: str) -> Config:
        return Config(domain.parse_sources(domain.load_yaml(sources)), domain.parse_rules(domain.load_yaml(rules)), domain.DomainPack.from_dict(domain.load_yaml(pack)))

    def settings(self) -> digest.Settings:
        lim = self.sources.limits
        return digest.Settings(window_hours=lim.window_hours, max_stories=lim.per_game, max_reddit=lim.per_game_reddit)


def run(spark: SparkSession, config: Config, landed: list[Landed], store: Store, now: Column, make: Callable[[], Fallback] | None = None, on_error: Callable = lambda f, e: None, seed: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Read the landed feeds, publish, and write the games' file; (published rows, funnel). A store
    without a history begins with the document seed."""
    check_patterns(spark, *config.sources.title_patterns, *config.sources.url_patterns)
    raw = read_all(spark, landed, now, on_error)
    out = digest.run(spark, raw, now, config.sources, config.rules, config.pack, store, make or (lambda: Fallback(Extractive())), config.settings(), seed)
    write_games(spark, config.rules, f"{store.base}/games")
    return out
