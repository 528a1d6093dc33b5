"""Queries with SQL over what a run reads, asks and stores: landed feeds, answers of models, the store, streams."""

from __future__ import annotations

import json
import uuid
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.domain import Rule, Rules
from riffle.operators import enrich, joins, providers, store
from riffle.operators.tables import shared_dir
from riffle.schema import ITEMS, raw_reject_reason, routed
from riffle.sources import feeds
from riffle.streaming import items as stream
from riffle.streaming import state

from . import sqltext as S
from .items_view import NOW, items_view, table
from .queries import _BROKEN, _REASON, _drained, _with, broken_items, query

#: NOW as epoch seconds, whatever the session's zone.
_NOW = 1_706_572_800


def _instant() -> Column:
    return F.timestamp_seconds(F.lit(_NOW))


def _land(lines: DataFrame, head: str = "", foot: str = "", each: int = 100, sep: str = " ") -> str:
    """Landed files of lines (n, value), `each` lines a file, in order of n; their folder."""
    path = f"{shared_dir(lines.sparkSession)}/landed-{uuid.uuid4().hex}"
    file = F.floor(F.col("n") / each)
    body = F.transform(F.array_sort(F.collect_list(F.struct(F.col("n").cast("long").alias("n"), "value"))), lambda x: x["value"])
    whole = lines.groupBy(file.alias("file")).agg(F.concat(F.lit(head), F.array_join(body, sep), F.lit(foot)).alias("value"))
    # One file for each row, whose names are in its order.
    whole.repartitionByRange(8, "file").sortWithinPartitions("file").select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def _fields(df: DataFrame) -> DataFrame:
    """Items with instants as epoch seconds and lists as text."""
    return df.select(
        "pos", "title", "url", "source", "source_type", "source_subreddit", F.unix_timestamp("published_at").alias("published"), "body_text", "language", "image_url", "author", "game_id",
        F.array_join("feed_categories", ",").alias("categories"),
    )


_COLUMNS = "pos, title, url, source, source_type, source_subreddit, published, body_text, language, image_url, author, game_id, categories"
_NUMBERED = "SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer"


@query(f"""WITH t AS ({_NUMBERED})
  SELECT pos, 'Item ' || CAST(k AS VARCHAR) || ' & more' AS title, 'https://s.example.org/' || CAST(k AS VARCHAR) AS url, 'Daily' AS source, 'media' AS source_type, CAST(NULL AS VARCHAR) AS source_subreddit,
    CAST(CASE WHEN k % 4 = 0 AND k % 8 = 0 THEN {_NOW} WHEN k % 4 = 0 THEN 1704189600 WHEN k % 9 = 0 THEN {_NOW} ELSE 1704189600 + k % 60 * 60 END AS BIGINT) AS published,
    'Hello ' || CAST(k AS VARCHAR) || chr(10) || 'there' AS body_text, 'en' AS language,
    CASE WHEN k % 7 = 0 THEN 'https://i.example.org/e' || CAST(k AS VARCHAR) WHEN k % 7 = 1 THEN 'https://i.example.org/m' || CAST(k AS VARCHAR) ELSE 'https://i.example.org/' || CAST(k AS VARCHAR) END AS image_url,
    CASE WHEN k % 6 = 0 THEN 'Ann' END AS author, CAST(NULL AS VARCHAR) AS game_id, CASE WHEN k % 2 = 0 THEN 'A,B' || CAST(k % 3 AS VARCHAR) ELSE '' END AS categories
  FROM t WHERE k % 5 > 0 AND k % 11 > 0""")
def rss_items(spark: SparkSession, d: str) -> DataFrame:
    """A landed RSS feed of the customers: untitled items and addresses that aren't of the web go, dates too far ahead become now."""
    line = """concat('<item><title>', if(k % 5 = 0, ' ', concat(' Item ', k, ' &amp; more ')), '</title><link>', if(k % 11 = 0, 'ftp://s/', 'https://s.example.org/'), k, '</link>',
      if(k % 4 = 0, if(k % 8 = 0, '', '<updated>2024-01-02T10:00:00Z</updated>'), if(k % 9 = 0, '<pubDate>Fri, 02 Jan 2026 10:00:00 GMT</pubDate>', concat('<pubDate>Tue, 02 Jan 2024 10:', lpad(k % 60, 2, '0'), ':00 GMT</pubDate>'))),
      '<description>&lt;p&gt;Hello &lt;b&gt;', k, '&lt;/b&gt;&lt;/p&gt;&lt;img src="https://i.example.org/', k, '"&gt; there</description>', if(k % 6 = 0, '<author> Ann </author>', ''),
      if(k % 7 = 0, concat('<enclosure url="https://i.example.org/e', k, '" type="image/png"/>'), if(k % 7 = 1, concat('<media:content url="https://i.example.org/m', k, '"/>'), '<enclosure url="https://i.example.org/a" type="audio/mpeg"/>')),
      if(k % 2 = 0, concat('<category> A </category><category>B', k % 3, '</category>'), ''), '</item>')"""
    path = _land(table(spark, d, "customer").selectExpr("c_custkey AS k").selectExpr("k AS n", f"{line} AS value"), '<rss xmlns:media="http://search.yahoo.com/mrss/"><channel>', "</channel></rss>")
    return _fields(feeds.read_feed(spark, feeds.Landed(path, "Daily", "media", "en"), _instant()))


@query(f"""WITH t AS ({_NUMBERED})
  SELECT pos, 'Post ' || CAST(k AS VARCHAR) AS title, 'https://r.example.org/' || CAST(k AS VARCHAR) AS url, 'r/ships' AS source, 'reddit' AS source_type, 'ships' AS source_subreddit,
    CAST(CASE WHEN k % 3 = 0 THEN 1704189600 ELSE 1704193200 END AS BIGINT) AS published, 'Text & ' || CAST(k AS VARCHAR) AS body_text, CAST(NULL AS VARCHAR) AS language,
    CASE WHEN k % 4 = 0 THEN 'https://i.example.org/t' ELSE 'https://i.example.org/' || CAST(k AS VARCHAR) END AS image_url,
    CASE WHEN k % 2 = 0 THEN '/u/u' || CAST(k AS VARCHAR) WHEN k % 3 = 0 THEN 'u@e.org' END AS author, CAST(NULL AS VARCHAR) AS game_id, '' AS categories
  FROM t ORDER BY pos LIMIT 100""")
def subreddit_items(spark: SparkSession, d: str) -> DataFrame:
    """A landed Atom feed of a subreddit, whose text is escaped twice; the first hundred entries."""
    line = """concat('<entry><title>Post ', k, '</title><link rel="self" href="https://r.example.org/self"/><link href="https://r.example.org/', k, '"/>',
      if(k % 3 = 0, '<updated>2024-01-02T10:00:00+00:00</updated>', '<published>2024-01-02T11:00:00+00:00</published><updated>2024-01-03T10:00:00+00:00</updated>'),
      '<content type="html">&amp;lt;p&amp;gt;Text &amp;amp;amp; ', k, '&amp;lt;img src="https://i.example.org/', k, '"&amp;gt;&amp;lt;/p&amp;gt;</content>', if(k % 4 = 0, '<media:thumbnail url="https://i.example.org/t"/>', ''),
      '<author>', if(k % 2 = 0, concat('<name>/u/u', k, '</name>'), if(k % 3 = 0, '<email>u@e.org</email>', '<name> </name>')), '</author><category term="x" label="r/ships"/></entry>')"""
    path = _land(table(spark, d, "customer").selectExpr("c_custkey AS k").selectExpr("k AS n", f"{line} AS value"), '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:media="http://search.yahoo.com/mrss/">', "</feed>")
    return _fields(feeds.read_feed(spark, feeds.Landed(path, "r/ships", "reddit", "en", "ships", limit=100), _instant()))


@query(f"""SELECT CAST(a * 4294967296 + n_nationkey AS BIGINT) AS pos, n_name AS title, 'https://g.example.org/' || CAST(n_nationkey AS VARCHAR) AS url, 'Steam · App' || CAST(a AS VARCHAR) AS source, 'steam' AS source_type,
    CAST(NULL AS VARCHAR) AS source_subreddit, CAST(CASE WHEN n_nationkey % 3 > 0 THEN 1704189600 + n_nationkey ELSE {_NOW} END AS BIGINT) AS published, 'News of ' || n_name AS body_text, 'en' AS language,
    'https://i.example.org/' || CAST(n_nationkey AS VARCHAR) AS image_url, CAST(NULL AS VARCHAR) AS author, CAST(70 + a AS VARCHAR) AS game_id, '' AS categories
  FROM nation, (SELECT unnest([0, 1]) AS a) WHERE n_nationkey % 4 > 0""")
def store_items(spark: SparkSession, d: str) -> DataFrame:
    """Landed store news of two apps, and a third whose file isn't JSON: it is reported and left out."""
    item = "named_struct('gid', string(n_nationkey), 'title', if(n_nationkey % 4 = 0, ' ', n_name), 'url', concat('https://g.example.org/', n_nationkey), 'contents', concat('<b>News</b> of ', n_name, '<img src=\"https://i.example.org/', n_nationkey, '\">'), 'date', if(n_nationkey % 3 > 0, 1704189600 + n_nationkey, 0))"
    lines = table(spark, d, "nation").selectExpr("n_nationkey AS n", f"concat(if(n_nationkey = 0, '', ','), to_json({item})) AS value")
    good = _land(lines, '{"appnews":{"appid":70,"newsitems":[', "]}}")
    bad = _land(lines.limit(1), "no such", "document")
    lost: list[str] = []
    apps = [feeds.Landed(p, name, "steam", "en", app_id=70 + i) for i, (p, name) in enumerate(((good, "App0"), (good, "App1"), (bad, "App2")))]
    got = _fields(feeds.read_all(spark, apps, _instant(), lambda feed, e: lost.append(feed.source)))
    return got if lost == ["App2"] else got.limit(0)


@query(_with("""SELECT pos, r AS reason, CASE WHEN r IS NULL THEN trim(title) END AS summary, CASE WHEN r IS NULL THEN CAST(CASE WHEN k = 3 THEN 5 ELSE relevance END AS INT) END AS relevance,
    CASE WHEN r IS NULL THEN CASE WHEN source_type = 'reddit' THEN 'rumor' ELSE category END END AS category, CASE WHEN r IS NULL THEN CASE WHEN k = 4 THEN '' ELSE 'Game ' || game END END AS game
  FROM (SELECT *, pos % 13 AS k, CASE WHEN pos % 13 = 11 THEN 'no_answer' WHEN pos % 13 IN (9, 10) THEN 'no_json' WHEN trim(title) = '' OR pos % 13 = 8 THEN 'summary_missing' WHEN pos % 13 IN (5, 6) THEN 'relevance_invalid'
    WHEN pos % 13 = 12 AND source_type <> 'reddit' THEN 'category_invalid' WHEN pos % 13 = 7 THEN 'language_invalid' END AS r FROM items)"""))
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """Raw answers about the items, right and wrong in a dozen ways, taken out of reasoning, fences and talk, and checked."""
    k = F.col("pos") % 13
    relevance = F.when(k == 3, '"5"').when(k == 5, "6").when(k == 6, "4.5").otherwise(F.col("relevance").cast("string"))
    rest = F.to_json(F.struct(
        F.when(k == 8, " ").otherwise(F.concat(F.lit(" "), "title")).alias("summary"), F.when(k == 12, "other").otherwise(F.col("category")).alias("category"),
        F.when(k == 7, "fr").otherwise("en").alias("language"), F.when(k == 4, "Unknown").otherwise(F.concat(F.lit("“Game  "), "game", F.lit("”"))).alias("game"),
    ))
    good = F.concat(F.lit('{"relevance": '), relevance, F.lit(", "), F.substr(rest, F.lit(2)))
    raw = (
        F.when(k == 1, F.concat(F.lit("<think>{no}</think>```json\n"), good, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Sure: "), good, F.lit(" Done {x}")))
        .when(k == 9, F.regexp_replace(good, ".$", "")).when(k == 10, "[1]").when(k != 11, good)
    )
    return enrich.validated(items_view(spark, d).select("pos", raw.alias("raw"), "source_type")).select("pos", F.col("ai_reason").alias("reason"), "ai.summary", "ai.relevance", "ai.category", "ai.game")


class Numbered:
    """A provider that answers by the number in the title: some rows get bad output, some a failure."""

    def answer(self, title: str, body: str, language: str | None, game: str, source_type: str) -> str:
        n = int(title.split()[1])
        if n % 6 == 0:
            raise providers.BadOutput("none")
        if n % 6 == 2:
            raise RuntimeError("lost")
        return json.dumps({"summary": f"About {n}", "relevance": 1 + n % 5, "category": "analisis", "language": "en", "game": f"Game {n % 3}" if n % 2 else ""})


@query(_with(f"""SELECT pos, {S.stable_id("url")} AS id, o AS outcome, CASE o WHEN 'cache' THEN 'Known ' || CAST(pos AS VARCHAR) WHEN 'new' THEN 'About ' || CAST(pos AS VARCHAR) END AS summary,
    CASE WHEN game <> 'General' THEN game WHEN o = 'new' AND pos % 2 = 1 THEN 'Game ' || CAST(pos % 3 AS VARCHAR) WHEN o = 'cache' THEN 'Cached' ELSE 'General' END AS game,
    CASE WHEN game <> 'General' THEN 'matcher' WHEN o = 'cache' OR o = 'new' AND pos % 2 = 1 THEN 'ai' ELSE 'generico' END AS game_origin,
    CAST(CASE o WHEN 'cache' THEN 2 WHEN 'new' THEN 1 + pos % 5 ELSE 1 END AS INT) AS relevance,
    CASE WHEN source_type = 'reddit' THEN 'rumor' WHEN o = 'cache' THEN 'lanzamiento' WHEN o = 'new' THEN 'analisis' ELSE 'rumor' END AS category,
    source_type <> 'reddit' AS is_verified, o = 'fallback' AS summary_is_fallback
  FROM (SELECT *, CASE WHEN pos % 4 = 1 THEN 'cache' WHEN pos % 6 IN (0, 2) THEN 'fallback' ELSE 'new' END AS o FROM items)"""))
def enriched_items(spark: SparkSession, d: str) -> DataFrame:
    """Items from cache, from a model, and the safe fallback where it failed."""
    at = F.col("pos")
    items = items_view(spark, d).withColumns({"title": F.concat(F.lit("Item "), at.cast("string")), "fetched_at": _instant(), "language": F.lit("en"), "game_id": F.lit(None).cast("string"), "author": F.lit(None).cast("string")}).drop("relevance", "category")
    seen = items.where("pos % 4 = 1").select("pos", "url", F.concat(F.lit("Known "), at.cast("string")).alias("summary"), F.lit(2).alias("relevance"), F.lit("lanzamiento").alias("category"), F.lit("Cached").alias("game"), F.lit("en").alias("language"))
    got = enrich.enrich(items, joins.build_cache(seen), lambda: providers.Fallback(Numbered()))
    return got.select("pos", "id", "outcome", "summary", "game", "game_origin", "relevance", "category", "is_verified", "summary_is_fallback")


_STORED = f""", s AS (SELECT pos, {S.stable_id("url")} AS id, 'T' || CAST(pos AS VARCHAR) AS title, CASE WHEN pos % 4 > 0 THEN 'S' || CAST(pos AS VARCHAR) WHEN pos % 3 = 0 THEN 'old' END AS summary, source_type, source_subreddit, game, published_at, relevance, category,
    CASE WHEN pos % 4 > 0 OR pos % 3 = 0 THEN false ELSE true END AS bare FROM items WHERE published_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOURS),
  m AS (SELECT * FROM s WHERE source_type = 'reddit' UNION ALL SELECT * FROM (SELECT * FROM s WHERE source_type <> 'reddit' ORDER BY published_at DESC, pos LIMIT 50))"""


_STORE_VERSIONS = f""", a AS (SELECT {S.stable_id("url")} AS id, pos, CASE WHEN pos % 4 > 0 THEN 'S' || CAST(pos AS VARCHAR) END AS summary FROM items),
  b AS (SELECT {S.stable_id("url")} AS id, pos + 1000000 AS pos, CASE WHEN pos % 4 <> 3 THEN 'again' END AS summary FROM items WHERE pos % 100 = 3)"""


def _stored(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("pos")
    text = lambda p: F.concat(F.lit(p), at.cast("string"))
    cols = {
        "id": store.stable_id(F.col("url")), "title": text("T"), "summary": F.when(at % 4 > 0, text("S")), "game_origin": F.lit("matcher"), "language": F.lit("en"), "game_id": F.lit(None).cast("string"),
        "published_at": F.timestamp_seconds(F.lit(_NOW) - at * 37 % 4320 * 60), "fetched_at": _instant(), "image": F.col("image_url"), "author": F.lit(None).cast("string"), "is_verified": F.col("source_type") != "reddit", "summary_is_fallback": at % 4 == 0,
    }
    return items_view(spark, d).withColumns(cols).select("pos", *ITEMS.fieldNames())


@query(_with("""SELECT pos, 'Answer with one JSON object with summary, relevance (1-5), category (lanzamiento, actualizacion, rumor, analisis), language (es or en) and game.' || chr(10) || 'Game: ' || game || chr(10) || 'Title: ' || title || chr(10) || 'Text: ' || substr(body_text, 1, 800) AS prompt FROM items"""))
def model_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a model is told about each item."""
    return items_view(spark, d).select("pos", enrich.prompt(F.col("title"), F.col("body_text"), F.col("game")).alias("prompt"))


@query(_with(_STORED + """ SELECT row_number() OVER (ORDER BY published_at DESC, pos) - 1 AS place, id, title, summary, source_type, source_subreddit, game, CAST(epoch(published_at) AS BIGINT) AS published, relevance, category, bare AS summary_is_fallback FROM m"""))
def stored_document(spark: SparkSession, d: str) -> DataFrame:
    """Two runs saved, the second over the first, whose summaries rows without one keep; the document read back, all its rows valid."""
    kept = store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    new = _stored(spark, d)
    kept.save(new.where("pos % 3 = 0").withColumns({"summary": F.lit("old"), "summary_is_fallback": F.lit(False)}), _instant(), 24, 50)
    kept.save(new, _instant(), 24, 50)
    good, bad = store.load(spark, kept._last()["document"])
    good = good.select(F.col("pos").cast("long").alias("place"), "id", "title", "summary", "source_type", "source_subreddit", "game", F.unix_timestamp("published_at").alias("published"), "relevance", "category", "summary_is_fallback")
    return good if bad.isEmpty() else good.limit(0)


@query(_with(f"""{_STORE_VERSIONS} SELECT 0 AS version, id, pos, summary FROM a UNION ALL SELECT 1, coalesce(b.id, a.id), coalesce(b.pos, a.pos), CASE WHEN b.id IS NULL THEN a.summary ELSE coalesce(b.summary, a.summary) END FROM a FULL OUTER JOIN b ON a.id = b.id"""))
def state_versions(spark: SparkSession, d: str) -> DataFrame:
    """The history of two runs, both still readable: the second one has a hundredth of the rows, and rewrites their buckets only."""
    kept = store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    new = _stored(spark, d)
    kept.save(new, _instant(), history_hours=1e5, history_most=10**9)
    first = kept._last()["buckets"]
    few = new.where("pos % 100 = 3").withColumns({"summary": F.when(F.col("pos") % 4 != 3, "again"), "pos": F.col("pos") + 1_000_000})
    kept.save(few, _instant(), history_hours=1e5, history_most=10**9)
    touched = {str(r[0]) for r in few.select(F.pmod(F.xxhash64("id"), F.lit(kept.buckets))).distinct().collect()}
    whole = [kept.history(v).select(F.lit(v).alias("version"), "id", "pos", "summary") for v in (0, 1)]
    both = whole[0].unionByName(whole[1])
    return both if {b for b, p in kept._last()["buckets"].items() if p != first.get(b)} == touched else both.limit(0)


@query(_with(f"""{_BROKEN} SELECT pos, reject_reason FROM ({{}}) WHERE reject_reason IS NOT NULL""".format(_REASON)))
def reject_table(spark: SparkSession, d: str) -> DataFrame:
    """Invalid rows as a run keeps them with its version: routed in one pass, partitioned by reason."""
    valid, rejects = routed(broken_items(spark, d), raw_reject_reason(), f"{shared_dir(spark)}/intake-{uuid.uuid4().hex}")
    kept = store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    kept.save(_stored(spark, d).join(valid.select("pos"), "pos", "left_semi"), _instant(), rejects=rejects)
    return kept.rejects().select("pos", "reject_reason")


@query(_with("""SELECT url, title, CASE k WHEN 1 THEN 'r/' || source WHEN 2 THEN 'Steam · ' || source ELSE source END AS source, CASE k WHEN 1 THEN 'reddit' WHEN 2 THEN 'steam' ELSE 'media' END AS source_type,
    CASE WHEN k = 1 THEN source END AS source_subreddit, CASE WHEN k = 0 THEN image_url END AS image, k <> 1 AS is_verified,
    CASE WHEN k = 3 THEN 'relevance_out_of_range' WHEN k = 4 THEN 'published_at_missing' WHEN k = 5 THEN 'id_mismatch' END AS reason FROM (SELECT *, pos % 6 AS k FROM items WHERE trim(title) <> '')"""))
def old_documents(spark: SparkSession, d: str) -> DataFrame:
    """The items as rows of old documents, a hundred each, migrated; what still breaks a rule is set apart with its reason."""
    k = F.col("pos") % 6
    kind = F.when(k == 1, "reddit").when(k == 2, "steam").otherwise("media").alias("source_type")
    name = F.when(k == 1, F.concat(F.lit("r/"), "source")).when(k == 2, F.concat(F.lit("Steam ┬À "), "source")).otherwise(F.col("source"))
    at = F.when(k == 2, "2024-01-02T10:00:00+02:00").when(k == 4, "2024-01-02T10:00:00").otherwise("2024-01-02T10:00:00Z")
    base = [
        "title", "url", F.lit("G").alias("game"), F.lit("en").alias("language"), at.alias("published_at"), F.lit("rumor").alias("category"), F.when(k != 1, "s").alias("summary"),
        F.when(k == 0, F.col("image_url")).alias("image_url"), F.when(k == 1, " ftp://i ").alias("image"), F.when(k == 5, "0").alias("id"), F.lit(3).alias("relevance"),
    ]
    nested = F.to_json(F.struct(*base, F.struct(F.col("source").alias("name"), F.lit("media").alias("type")).alias("source")))
    plain = F.to_json(F.struct(*base, kind, name.alias("source")))
    wrong = F.replace(plain, F.lit('"relevance":3'), F.lit('"relevance":"3"'))
    rows = items_view(spark, d).where(F.trim("title") != "").select(F.col("pos").alias("n"), F.when(k == 0, nested).when(k == 3, wrong).otherwise(plain).alias("value"))
    good, bad = store.load(spark, _land(rows, '{"news":[', "]}", sep=","))
    cols = ("url", "title", "source", "source_type", "source_subreddit", "image", "is_verified")
    return good.select(*cols, F.lit(None).cast("string").alias("reason")).unionByName(bad.select(*cols, F.col("reject_reason").alias("reason")))


@query("SELECT p_brand AS name, CASE WHEN min(p_partkey) % 2 = 0 THEN min(p_type) || '.png' END AS logo FROM part GROUP BY p_brand")
def games_file(spark: SparkSession, d: str) -> DataFrame:
    """The games' file of rules named by the brands, as written, read for its logos."""
    path = f"{shared_dir(spark)}/games-{uuid.uuid4().hex}"
    brands = table(spark, d, "part").groupBy("p_brand").agg(F.min("p_type").alias("type"), F.min("p_partkey").alias("key")).collect()  # a rule for each brand
    store.write_games(spark, Rules(include=tuple(Rule(b["p_brand"], (f"B{b['key']}",), logo=f"{b['type']}.png" if b["key"] % 2 == 0 else None) for b in brands), exclude=()), path)
    return store.read_logos(spark, path)


@query("""SELECT CAST(time_bucket(INTERVAL 30 SECOND, ts) AS TIMESTAMP) - k * INTERVAL 30 SECOND AS start, count(*) AS n, sum(value) AS total
  FROM (SELECT ts, CAST(value AS DECIMAL(18, 4)) AS value, unnest([0, 1]) AS k FROM events) GROUP BY ALL""")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """What was spent in windows of a minute that start every half minute, by a stream."""
    got = _drained(spark, d, lambda s: stream.windowed(s.withColumn("value", F.col("value").cast("decimal(18,4)")), "ts", "60 seconds", "30 seconds", value="value"), "complete")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.col("total").cast("decimal(38,4)").alias("total"))


@query(f"""SELECT event_id, CAST(CASE WHEN epoch(ts) > {_NOW} - 20 * 86400 + 86400 THEN {_NOW} - 20 * 86400 ELSE floor(epoch(ts)) END AS BIGINT) AS published, event_id % 4 = 1 AS hit, CASE WHEN event_id % 4 = 1 THEN 'Known ' || CAST(event_id AS VARCHAR) END AS summary FROM events""")
def stream_cached(spark: SparkSession, d: str) -> DataFrame:
    """A stream whose dates too far ahead become now, joined with the cache of answers."""
    at, url = F.col("event_id"), F.concat(F.lit("https://e.example.org/"), F.col("event_id").cast("string"))
    seen = table(spark, d, "events").where(at % 4 == 1).select(at.alias("pos"), url.alias("url"), F.concat(F.lit("Known "), at.cast("string")).alias("summary"), F.lit(1).alias("relevance"), F.lit("rumor").alias("category"), F.lit("G").alias("game"), F.lit("en").alias("language"))
    cache = joins.build_cache(seen)
    present = F.timestamp_seconds(F.lit(_NOW - 20 * 86_400))
    rows = lambda s: stream.cached(stream.clamp_ahead(s.select(at, F.concat(url, F.lit("/?utm_source=x")).alias("url"), F.col("ts").alias("published_at")), present), cache)
    got = _drained(spark, d, lambda s: rows(s).select("event_id", F.unix_timestamp("published_at").alias("published"), "hit", F.col("ai_summary").alias("summary")), "append")
    return got


@query(f"""SELECT user_id, event_id, CAST(epoch_us(ts) AS BIGINT) AS opened FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
  WHERE (before IS NULL OR ts - before > INTERVAL 12 HOUR) AND ts >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY""")
def stream_lives(spark: SparkSession, d: str) -> DataFrame:
    """Users that a stream lets through when it hasn't seen them for 12 hours, of the last ten days."""
    with state.rocks_state(spark):
        rows = lambda s: state.emitted(state.first_of_lives(s, ["user_id"], "ts", "event_id", timedelta(hours=12)), "ts", _instant(), timedelta(days=10))
        return _drained(spark, d, lambda s: rows(s).select("user_id", "event_id", F.unix_micros("ts").alias("opened")), "append")
