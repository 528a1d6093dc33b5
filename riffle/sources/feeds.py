"""Feeds as tables: RSS and Atom (XML) and store news (JSON), from landed files, into items_raw.

All files of one form are read by one scan, a row each, joined with the table of feeds and
parsed by the executors; what can't be read is a column beside the others, so one bad file
stops nothing. Parts of a row that need an HTML parser run in Arrow batches, all else is
native.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riffle.functions.dates import epoch, resolve, rfc822
from riffle.functions.markup import first_image, strip_html, unescape
from riffle.operators.tables import written
from riffle.schema import ITEMS_RAW, is_http, optional_text

_LINKED = "array<struct<_url:string,_type:string>>"
RSS_ITEM = (
    "title string, link string, pubDate string, updated string, description string, author string, "
    f"category array<string>, enclosure {_LINKED}, `media:content` {_LINKED}, `media:thumbnail` {_LINKED}"
)
ATOM_ENTRY = (
    "title string, link array<struct<_href:string,_rel:string>>, published string, updated string, content string, summary string, "
    "author struct<name:string,email:string>, category array<struct<_term:string,_label:string>>, "
    f"`media:content` {_LINKED}, `media:thumbnail` {_LINKED}"
)
STORE_ITEM = "gid string, title string, url string, contents string, feedlabel string, date long"


def _nested(fields: str) -> str:
    """Fields as the inside of a struct type."""
    return re.sub(r"(^|, )(`?[\w:]+`?) ", r"\1\2: ", fields)


#: What a whole file of each form is parsed as; items of old feeds stand beside their channel.
FORMS = {
    "rss": f"channel struct<item: array<struct<{_nested(RSS_ITEM)}>>>, item array<struct<{_nested(RSS_ITEM)}>>, _corrupt_record string",
    "atom": f"entry array<struct<{_nested(ATOM_ENTRY)}>>, _corrupt_record string",
    "store": f"appnews struct<newsitems: array<struct<{_nested(STORE_ITEM)}>>>, _corrupt_record string",
}


@dataclass(frozen=True)
class Landed:
    """A landed feed: where its file is, and what its rows get."""

    path: str
    source: str
    kind: str  # media, reddit or steam
    language: str | None = None
    subreddit: str | None = None
    app_id: int | None = None
    atom: bool = False
    limit: int | None = None

    @property
    def form(self) -> str:
        return "store" if self.kind == "steam" else "atom" if self.atom or self.kind == "reddit" else "rss"


class EmptySource(RuntimeError):
    """A source that must have rows has none, or none of a kind could be read."""


def _web(c: Column) -> Column:
    return F.when(is_http(c), c)


def _first_of(links: Column, images_only: bool = False) -> Column:
    """Address of the first http(s) link of an array, of images only if asked."""
    ok = F.filter(links, lambda x: is_http(x["_url"]) & (F.coalesce(x["_type"].startswith("image/"), F.lit(False)) if images_only else F.lit(True)))
    return F.try_element_at(ok, F.lit(1))["_url"]


def _iso(c: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(F.trim(c)), rfc822(c))


_FEED = "k int, address string, source string, source_type string, source_subreddit string, feed_language string, game_id string, most int"


#: An address without authority is written with one slash or with three.
_PLAIN = re.compile("^([a-zA-Z0-9+.-]+):///")


def _located(spark: SparkSession, feeds: list[tuple[int, Landed]]) -> tuple[DataFrame, list[str], list[int]]:
    """(table of feeds, paths that exist, numbers of feeds without one)."""
    rows, paths, missing = [], {}, []
    for k, f in feeds:
        path = spark._jvm.org.apache.hadoop.fs.Path(f.path)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            missing.append(k)
            continue
        address = _PLAIN.sub(r"\1:/", fs.makeQualified(path).toUri().toString()).rstrip("/")
        paths[address] = f.path
        source = f"Steam · {f.source}" if f.kind == "steam" else f.source
        rows.append((k, address, source, f.kind, f.subreddit, f.language, None if f.app_id is None else str(f.app_id), f.limit or None))
    return spark.createDataFrame(rows, _FEED), list(paths.values()), missing


def _parsed(form: str) -> tuple[Column, Column]:
    """(items of a file, whether it is no document of the form)."""
    if form == "store":
        whole = F.from_json("value", FORMS[form], {"mode": "PERMISSIVE"})
        items = whole["appnews"]["newsitems"]
        return items, whole["appnews"].isNull()
    whole = F.from_xml("value", FORMS[form], {"mode": "PERMISSIVE"})
    items = whole["entry"] if form == "atom" else F.concat(*[F.coalesce(x, F.array().cast(f"array<struct<{_nested(RSS_ITEM)}>>")) for x in (whole["channel"]["item"], whole["item"])])
    return items, whole.isNull() | whole["_corrupt_record"].isNotNull()


def read_form(spark: SparkSession, form: str, feeds: list[tuple[int, Landed]], now: Column) -> tuple[DataFrame, dict[int, str]]:
    """(rows, faults) of all feeds of a form, given with numbers k: rows are items_raw with k, pos
    counting within a feed; faults say of a feed's number why it is left out."""
    table, paths, missing = _located(spark, feeds)
    faults = dict.fromkeys(missing, "missing")
    if not paths:
        return spark.createDataFrame([], ITEMS_RAW).withColumn("k", F.lit(0)), faults
    texts = spark.read.text(paths, wholetext=True).select("value", F.regexp_replace("_metadata.file_path", _PLAIN.pattern, "$1:/").alias("file"))
    # A feed is landed as a file, or as a folder of files.
    placed = texts.withColumn("address", F.explode(F.array("file", F.regexp_replace("file", "/[^/]*$", "")))).join(F.broadcast(table), "address")
    items, bad = _parsed(form)
    read = placed.select(*[c for c in table.columns if c != "address"], "file", bad.alias("bad"), F.posexplode_outer(items).alias("row", "x"))
    rows = written(read, f"feed-{form}")
    # One row for each feed; an empty file gives none.
    found = {r["k"]: r for r in rows.groupBy("k").agg(F.max("bad").alias("bad"), F.count("x").alias("n")).collect()}
    for k in {k for k, _ in feeds} - set(missing):
        if k not in found or found[k]["bad"] or not found[k]["n"]:
            faults[k] = "unreadable" if k in found and found[k]["bad"] else "empty"
    return _items(_numbered(rows.where("x is not null and not bad")), form, now), faults


def _natural(c: Column) -> Column:
    """Text in whose order the numbers in a name go by value: c1000 comes after c999, as files are numbered by Spark."""
    return F.regexp_replace(F.regexp_replace(c, "([0-9]+)", "0" * 20 + "$1"), "0*([0-9]{20,})", "$1")


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with pos, counting within a feed by the order of its files' names. A task numbers the rows of
    a file; of a feed only the files' counts come together."""
    files = rows.groupBy("k", "file").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("k").orderBy(_natural(F.col("file")), "file").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("k", "file", F.coalesce(before, F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("k", "file").orderBy("row"))
    return rows.join(starts, ["k", "file"]).withColumn("pos", F.col("start") + nth.cast("long") - 1).drop("start")


def _items(df: DataFrame, form: str, now: Column) -> DataFrame:
    """items_raw of parsed rows: without title or web address a row is dropped; the first `most` of each feed stay.

    RSS: the image is an image enclosure, then media:content, then the first img of the text.
    Atom: reddit's entries are unescaped first, have no language, and take a thumbnail before other images."""
    x, none, reddit = (lambda c: F.col("x").getField(c)), F.array().cast("array<string>"), F.col("source_type") == "reddit"
    if form == "rss":
        columns = {
            "title": F.trim(x("title")), "url": F.trim(x("link")), "published_at": resolve(_iso(x("pubDate")), _iso(x("updated")), now), "body_text": x("description"), "author": optional_text(x("author")),
            "image_url": F.coalesce(_first_of(x("enclosure"), True), _first_of(x("media:content")), first_image(x("description"))),
            "feed_categories": F.coalesce(F.filter(F.transform(x("category"), lambda c: F.trim(c)), lambda c: c != ""), none),
        }
    elif form == "atom":
        plain = F.coalesce(x("content"), x("summary"), F.lit(""))
        text = F.when(reddit, unescape(plain)).otherwise(plain)
        link = F.coalesce(F.try_element_at(F.filter(x("link"), lambda v: F.coalesce(v["_rel"], F.lit("alternate")) == "alternate"), F.lit(1)), F.try_element_at(x("link"), F.lit(1)))["_href"]
        terms = F.transform(x("category"), lambda c: F.coalesce(optional_text(c["_term"]), optional_text(c["_label"])))
        columns = {
            "title": F.trim(x("title")), "url": F.trim(link), "published_at": resolve(_iso(x("published")), _iso(x("updated")), now), "body_text": text,
            "author": F.coalesce(optional_text(x("author")["name"]), optional_text(x("author")["email"])), "language": F.when(~reddit, F.col("feed_language")),
            "image_url": F.coalesce(F.when(reddit, _first_of(x("media:thumbnail"))), _first_of(x("media:content")), first_image(text)),
            "feed_categories": F.when(reddit, none).otherwise(F.coalesce(F.array_compact(terms), none)),
        }
    else:
        columns = {
            "title": F.trim(x("title")), "url": F.trim(x("url")), "published_at": resolve(epoch(x("date")), F.lit(None).cast("timestamp"), now),
            "body_text": x("contents"), "image_url": first_image(x("contents")),
        }
    fixed = {"fetched_at": now, "language": F.col("feed_language"), "game": F.lit(None), "author": F.lit(None), "feed_categories": none}
    both = {c: F.col(c) for c in ("pos", "source", "source_type", "source_subreddit", "game_id")} | fixed | columns
    rows = df.select("k", "most", *[both[f.name].cast(f.dataType).alias(f.name) for f in ITEMS_RAW.fields])
    rows = rows.where(optional_text(F.col("title")).isNotNull() & is_http(F.col("url")))
    # Rows of feeds without a limit needn't come together.
    apart = F.when(F.col("most").isNull(), F.col("pos"))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("k", apart).orderBy("pos"))).where("most is null or _nth <= most")
    return rows.select("k", *ITEMS_RAW.fieldNames()).withColumn("body_text", strip_html("body_text"))


def read_feed(spark: SparkSession, feed: Landed, now: Column) -> DataFrame:
    """items_raw of one feed; raises EmptySource where its file is missing or can't be read."""
    rows, faults = read_form(spark, feed.form, [(0, feed)], now)
    if faults and faults[0] != "empty":
        raise EmptySource(f"{feed.source}: {faults[0]}")
    return rows.drop("k")


def read_all(spark: SparkSession, feeds: list[Landed], now: Column, on_error: Callable[[Landed, Exception], None] = lambda f, e: None) -> DataFrame:
    """All feeds, media first, then stores, then reddit, with pos running on.

    A feed that can't be read is reported and left out; a store or subreddit without rows
    counts as such; if all apps fail, that is an error of its own, of the first app.
    """
    order = sorted(feeds, key=lambda f: ("media", "steam", "reddit").index(f.kind))
    parts, lost = [], set()
    for form in FORMS:
        mine = [(k, f) for k, f in enumerate(order) if f.form == form]
        if not mine:
            continue
        rows, faults = read_form(spark, form, mine, now)
        for k, why in sorted(faults.items()):
            if why != "empty" or order[k].kind != "media":
                lost.add(k)
                on_error(order[k], EmptySource(f"{order[k].source}: {why}"))
        parts.append(rows.withColumn("pos", F.col("pos") + F.col("k").cast("long") * (1 << 32)).drop("k"))
    apps = [k for k, f in enumerate(order) if f.kind == "steam"]
    if apps and lost >= set(apps):
        on_error(order[apps[0]], EmptySource("no app could be read"))
    if not parts:
        return spark.createDataFrame([], ITEMS_RAW)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def reddit_as_rumors(df: DataFrame, game: str = "Reddit Rumors") -> DataFrame:
    """reddit rows under one game of their own, without categories."""
    is_reddit = F.col("source_type") == "reddit"
    return df.withColumns({"game": F.when(is_reddit, game).otherwise(F.col("game")), "feed_categories": F.when(is_reddit, F.array().cast("array<string>")).otherwise(F.col("feed_categories"))})
