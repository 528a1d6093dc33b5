"""Queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riffle.domain import DomainPack, Rule
from riffle.functions import dates, markup, text, urls
from riffle.operators import cluster, dedup, filters, joins, mentions, reports, topic, topk
from riffle.operators.tables import shared_dir
from riffle.schema import raw_reject_reason
from riffle.streaming import items as stream

from . import sqltext as S
from .items_view import ITEMS_SQL, NOW, items_view, now, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: A small pack over words that the invented texts hold.
PACK = DomainPack.from_dict({
    "strong_positive": ["that", "eau", "pfen", "mente"], "weak_positive": ["with", "from", "pour", "und", "los"],
    "strong_negative": ["stupid", "trash"], "weak_negative": ["clown", "loser", "pathetic"], "suppress": ["the that"],
    "known_titles": {"thering": "Thering", "ingoning": "Ingoning"}, "game_keys": {"g1": "one", "g10": "ten"}, "anchors": ["this", "was", "une", "eine", "una"],
    "stop": ["the", "and", "for", "les", "des", "der", "die", "las", "los", "que"], "noise": ["was", "are"], "events": ["with", "from", "that", "dans", "nicht", "para"],
    "entity_stop": ["the", "and", "les", "der", "los"],
})
EXCLUDED = (Rule("moron", ("scum",)), Rule("disgusting"))
INCLUDED = (Rule("That With", ("with that",)), Rule("Eau", ("aux",)), Rule("Und"), Rule("Los", ("las",)))
TITLE_PATTERNS, URL_PATTERNS = ("^the ", "!!"), ("src7[.]",)
FEATURED = ("g1", "G2", "g7")


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def _with(sql: str) -> str:
    return f"WITH {ITEMS_SQL} {sql}"


CARD = "pos, title, url, game, category, published_at"


@query(_with(f"SELECT {CARD} FROM items WHERE game = 'g3' AND category <> 'rumor'"))
def section_filter(spark: SparkSession, d: str) -> DataFrame:
    """The reader's query: one entity, news only."""
    return filters.section(items_view(spark, d), "g3", "news").select(*CARD.split(", "))


@query(f"SELECT page_id, {S.normal_url('url')} AS norm_url, {S.stable_id('url')} AS id FROM pages")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.normal_url(F.col("url")).alias("norm_url"), urls.stable_id(F.col("url")).alias("id"))


@query(f"SELECT doc_id, md5({S.fold('text')}) AS folded, md5({S.normal_title('text')}) AS titled FROM documents")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(text.fold(c)).alias("folded"), F.md5(text.normal_title(c)).alias("titled"))


@query(f"SELECT doc_id, array_to_string({S.keywords('text', PACK.stop, PACK.noise, PACK.events)}, ',') AS keywords FROM documents")
def keyword_extraction(spark: SparkSession, d: str) -> DataFrame:
    kw = text.keywords(F.col("text"), PACK.stop, PACK.noise, PACK.events)
    return table(spark, d, "documents").select("doc_id", F.array_join(kw, ",").alias("keywords"))


@query(_with(f"SELECT pos, array_to_string({S.entities('title', 'body_text', 'game', PACK.entity_stop)}, ',') AS entities FROM items"))
def entity_extraction(spark: SparkSession, d: str) -> DataFrame:
    en = text.entities(F.col("title"), F.col("body_text"), F.col("game"), PACK.entity_stop)
    return items_view(spark, d).select("pos", F.array_join(en, ",").alias("entities"))


@query(f"SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_duplicates(table(spark, d, "documents"))


@query(_with("SELECT pos, title, game FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY published_at DESC, pos DESC) AS r FROM items) WHERE r = 1"))
def dedup_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = items_view(spark, d).select("pos", "title", "game", "published_at")
    return dedup.last_wins(rows, ["title"], [F.col("published_at"), F.col("pos")]).select("pos", "title", "game")


@query(_with(f"SELECT pos FROM items WHERE NOT {S.mention('title || chr(32) || body_text', ['moron', 'scum', 'disgusting'])}"))
def poison_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.without_excluded(items_view(spark, d), EXCLUDED).select("pos")


@query(_with("SELECT pos FROM items WHERE NOT regexp_matches(title, '^the |!!', 'i') AND NOT regexp_matches(url, 'src7[.]', 'i')"))
def regex_exclude(spark: SparkSession, d: str) -> DataFrame:
    return filters.without_patterns(items_view(spark, d), TITLE_PATTERNS, URL_PATTERNS).select("pos")


@query(_with(f"SELECT pos, published_at FROM items WHERE published_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR"))
def age_window(spark: SparkSession, d: str) -> DataFrame:
    return filters.by_age(items_view(spark, d), now(), 24).select("pos", "published_at")


@query(_with("""SELECT pos, game, relevance FROM (SELECT *, row_number() OVER (PARTITION BY game ORDER BY relevance DESC, published_at DESC, pos) AS r FROM items WHERE lower(game) <> 'general') WHERE r <= 8
  UNION ALL SELECT pos, game, relevance FROM items WHERE lower(game) = 'general'"""))
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    return topk.per_game(items_view(spark, d), 8, PACK.generic_names).select("pos", "game", "relevance")


@query(_with("""SELECT pos, game, source_type FROM (SELECT *, row_number() OVER (PARTITION BY game, source_type = 'reddit' ORDER BY relevance DESC, published_at DESC, pos) AS r FROM items)
  WHERE r <= CASE WHEN source_type = 'reddit' THEN 3 ELSE 5 END"""))
def topk_two_quota(spark: SparkSession, d: str) -> DataFrame:
    return topk.per_game_two_quotas(items_view(spark, d), media=5, reddit=3).select("pos", "game", "source_type")


_MICROS = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(published_at))"
_SCORE = (
    f"(greatest(0.0, least(1.0, 1.0 - {_MICROS} / 3.6e9 / 48.0)) + CASE WHEN len(list_intersect({S.title_words('title')}, {S.words(PACK.anchors)})) > 0 THEN 2.0 ELSE 0.0 END"
    " + CASE WHEN lower(trim(game)) IN ('g1', 'g2', 'g7') THEN 3.0 ELSE 0.0 END + CASE WHEN source_type <> 'reddit' THEN 1.0 ELSE 0.0 END)"
)


@query(_with(f"SELECT pos, round({_SCORE}, 6) AS score FROM items"))
def relevance_score(spark: SparkSession, d: str) -> DataFrame:
    return items_view(spark, d).select("pos", F.round(topk.score(now(), PACK.anchors, FEATURED), 6).alias("score"))


@query(_with(f""", scored AS (SELECT *, round({_SCORE}, 6) AS score FROM items),
  ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, published_at DESC, url DESC, pos) AS r,
    row_number() OVER (PARTITION BY source_type = 'reddit' ORDER BY score DESC, published_at DESC, url DESC, pos) AS rc FROM scored),
  n AS (SELECT count_if(source_type = 'reddit' AND r <= 60) AS nr, count_if(source_type = 'reddit') AS total FROM ranked),
  s AS (SELECT nr, greatest(0, least(20 - nr, total - nr, 60 - nr)) AS s FROM n)
  SELECT pos, score FROM ranked, s WHERE (source_type = 'reddit' AND rc <= nr + s) OR (source_type <> 'reddit' AND rc <= 60 - nr - s)"""))
def prerank_floor(spark: SparkSession, d: str) -> DataFrame:
    """The 60 best rows, 20 of them reddit's at least."""
    scored = items_view(spark, d).withColumn("score", F.round(topk.score(now(), PACK.anchors, FEATURED), 6))
    return topk.with_floor(scored, F.col("score"), most=60, floor=20).select("pos", "score")


def _retention_sql(hours: int, total: int, media: int | None, reddit: int | None) -> str:
    return _with(f""", young AS (SELECT * FROM items WHERE published_at >= TIMESTAMP '{NOW}' - INTERVAL {hours} HOUR),
  capped AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY published_at DESC, pos) AS r0 FROM young WHERE source_type <> 'reddit') WHERE r0 <= {total}),
  m AS (SELECT pos, published_at, game, row_number() OVER (PARTITION BY game ORDER BY published_at DESC, pos) AS r FROM capped),
  e AS (SELECT pos, published_at, game, row_number() OVER (PARTITION BY game ORDER BY published_at DESC, pos) AS r FROM young WHERE source_type = 'reddit')
  SELECT pos, published_at, game FROM m WHERE {f'r <= {media}' if media else 'true'} UNION ALL SELECT pos, published_at, game FROM e WHERE {f'r <= {reddit}' if reddit else 'true'}""")


@query(_retention_sql(24, 200, None, None))
def retention_published(spark: SparkSession, d: str) -> DataFrame:
    return topk.retain(items_view(spark, d), now(), 24, 200).select("pos", "published_at", "game")


@query(_retention_sql(48, 300, 6, 2))
def retention_history(spark: SparkSession, d: str) -> DataFrame:
    return topk.retain(items_view(spark, d), now(), 48, 300, 6, 2).select("pos", "published_at", "game")


@query("SELECT source, pos FROM (SELECT source, doc_id AS pos, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 20")
def per_source_head(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", F.col("doc_id").alias("pos"))
    return topk.within(rows, ["source"], [F.col("pos").asc()], 20)


def _store(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An old and a new state table: the new one has every other row again, some without summary."""
    summary = F.when(F.col("pos") % 7 == 0, F.lit("  ")).when(F.col("pos") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("pos").cast("string")))
    base = items.select(urls.stable_id(F.col("url")).alias("id"), "pos", "title", "relevance")
    old = base.where("relevance <= 4").withColumn("summary", summary)
    new = base.where("relevance >= 3").withColumn("summary", F.when(F.col("pos") % 4 == 1, F.lit(None)).otherwise(F.concat(F.lit("n"), F.col("pos").cast("string")))).withColumn("relevance", F.col("relevance") + 10)
    return old, new


_STORE = f""", base AS (SELECT {S.stable_id('url')} AS id, pos, title, relevance FROM items),
  old AS (SELECT id, pos, title, relevance, CASE WHEN pos % 7 = 0 THEN '  ' WHEN pos % 3 = 0 THEN NULL ELSE 's' || pos END AS summary FROM base WHERE relevance <= 4),
  new AS (SELECT id, pos, title, relevance + 10 AS relevance, CASE WHEN pos % 4 = 1 THEN NULL ELSE 'n' || pos END AS summary FROM base WHERE relevance >= 3)"""


@query(_with(f"""{_STORE} SELECT coalesce(n.id, o.id) AS id, coalesce(n.pos, o.pos) AS pos, coalesce(n.relevance, o.relevance) AS relevance,
  CASE WHEN n.id IS NULL THEN o.summary ELSE coalesce(n.summary, CASE WHEN trim(o.summary) <> '' THEN o.summary END) END AS summary
  FROM old o FULL OUTER JOIN new n ON o.id = n.id"""))
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    old, new = _store(items_view(spark, d))
    return joins.upsert(old, new).select("id", "pos", "relevance", "summary")


def _cache(items: DataFrame) -> DataFrame:
    cols = ["url", "pos", "summary", "relevance", "category", "game", "language"]
    one = items.where("relevance <= 3").withColumn("summary", F.concat(F.lit("a"), F.col("pos").cast("string"))).select(cols)
    two = items.where("relevance between 2 and 4").withColumn("summary", F.when(F.col("pos") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("b"), F.col("pos").cast("string")))).select(cols)
    return joins.build_cache(one, two)


_CACHE = f""", parts AS (SELECT {S.normal_url('url')} AS norm_url, 'a' || pos AS summary, pos, 0 AS t FROM items WHERE relevance <= 3
  UNION ALL SELECT {S.normal_url('url')}, CASE WHEN pos % 5 = 0 THEN ' ' ELSE 'b' || pos END, pos, 1 FROM items WHERE relevance BETWEEN 2 AND 4),
  cache AS (SELECT norm_url, summary FROM (SELECT *, row_number() OVER (PARTITION BY norm_url ORDER BY t DESC, pos DESC) AS r FROM parts WHERE trim(summary) <> '') WHERE r = 1)"""


@query(_with(f"{_CACHE} SELECT pos, c.norm_url IS NOT NULL AS hit, c.summary AS ai_summary FROM items LEFT JOIN cache c ON c.norm_url = {S.normal_url('url')}"))
def cache_join(spark: SparkSession, d: str) -> DataFrame:
    items = items_view(spark, d)
    return joins.with_cache(items, _cache(items)).select("pos", "hit", "ai_summary")


@query(_with(f"{_CACHE} SELECT pos FROM items WHERE {S.normal_url('url')} NOT IN (SELECT norm_url FROM cache)"))
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    items = items_view(spark, d)
    return joins.cache_misses(items, _cache(items)).select("pos")


@query(_with("SELECT count(*) AS total, count_if(source_type = 'reddit') AS reddit, count_if(source_type <> 'reddit') AS media_steam FROM items"))
def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.by_class(items_view(spark, d))


@query(_with("SELECT source_subreddit, count(*) AS n FROM items WHERE source_type = 'reddit' GROUP BY 1"))
def subreddit_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.by_subreddit(items_view(spark, d)).withColumnRenamed("count", "n")


@query(_with(f"SELECT min(published_at) FILTER (published_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) AS oldest_accepted, max(published_at) FILTER (published_at < TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) AS newest_rejected FROM items"))
def age_edges(spark: SparkSession, d: str) -> DataFrame:
    return reports.age_edges(items_view(spark, d), now() - F.expr("INTERVAL 24 HOURS"))


@query(_with("""SELECT source_type = 'reddit' AS is_reddit, count_if(relevance <= 2) AS "cache", count_if(relevance = 3) AS "new", count_if(relevance >= 4) AS fallback FROM items GROUP BY 1"""))
def ai_outcomes(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("relevance") <= 2, "cache").when(F.col("relevance") == 3, "new").otherwise("fallback")
    return reports.outcomes(items_view(spark, d).withColumn("outcome", outcome))


@query(_with("SELECT CASE WHEN game = 'General' THEN 'generico' WHEN relevance > 3 THEN 'ai' ELSE 'matcher' END AS game_origin, count(*) AS n FROM items GROUP BY 1"))
def origin_counts(spark: SparkSession, d: str) -> DataFrame:
    origin = F.when(F.col("game") == "General", "generico").when(F.col("relevance") > 3, "ai").otherwise("matcher")
    return reports.histogram(items_view(spark, d).withColumn("game_origin", origin), "game_origin")


@query(_with("SELECT count_if(game <> 'General' AND source_type <> 'reddit') AS identified, count_if(game = 'General' AND source_type <> 'reddit') AS generic, count_if(source_type = 'reddit') AS reddit FROM items"))
def identification(spark: SparkSession, d: str) -> DataFrame:
    return reports.identification(items_view(spark, d), topk.is_generic(F.col("game"), PACK.generic_names))


@query(_with(f"""SELECT 0 AS ord, 'all' AS stage, count(*) AS total, count_if(source_type = 'reddit') AS reddit, count_if(source_type <> 'reddit') AS media_steam FROM items
  UNION ALL SELECT 1, 'young', count(*), count_if(source_type = 'reddit'), count_if(source_type <> 'reddit') FROM items WHERE published_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR
  UNION ALL SELECT 2, 'clean', count(*), count_if(source_type = 'reddit'), count_if(source_type <> 'reddit') FROM items WHERE published_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND NOT regexp_matches(title, '^the |!!', 'i') AND NOT regexp_matches(url, 'src7[.]', 'i')"""))
def funnel(spark: SparkSession, d: str) -> DataFrame:
    """Stages counted in one pass over the items, as a run's own jobs count them."""
    meter = reports.Meter()
    young = meter.through(filters.by_age(meter.through(items_view(spark, d), "all"), now(), 24), "young")
    meter.through(filters.without_patterns(young, TITLE_PATTERNS, URL_PATTERNS), "clean").write.format("noop").mode("overwrite").save()
    return meter.funnel(spark)


@query(_with("SELECT DISTINCT game FROM items"))
def distinct_entities(spark: SparkSession, d: str) -> DataFrame:
    return items_view(spark, d).select("game").distinct()


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dim_lookup(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return joins.lookup(joins.lookup(table(spark, d, "customer"), nation, "c_nationkey"), region, "n_regionkey").select("c_custkey", "n_name", "r_name")


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 4) AS spent FROM events""")
def sliding_spend(spark: SparkSession, d: str) -> DataFrame:
    return topk.trailing_sum(table(spark, d, "events"), "value", "ts", 86_400, ["user_id"]).select("event_id", F.round("spent", 4).alias("spent"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(_with(f"""SELECT pos, CASE WHEN {S.mention('title || chr(32) || body_text', ['that with', 'with that'])} THEN 'That With' WHEN {S.mention('title || chr(32) || body_text', ['eau', 'aux'])} THEN 'Eau'
  WHEN {S.mention('title || chr(32) || body_text', ['und'])} THEN 'Und' WHEN {S.mention('title || chr(32) || body_text', ['los', 'las'])} THEN 'Los' END AS rule FROM items"""))
def first_rule(spark: SparkSession, d: str) -> DataFrame:
    return items_view(spark, d).select("pos", mentions.first_rule(INCLUDED, F.col("title"), F.col("body_text")).alias("rule"))


@query(f"""WITH terms AS (SELECT DISTINCT trim({S.fold('p_type')}) AS term FROM part UNION SELECT unnest(['that with', 'in the', 'stupid', 'de la', 'eau'])),
  folded AS (SELECT doc_id, ' ' || trim({S.fold('text')}) || ' ' AS t FROM documents)
  SELECT doc_id, term FROM folded, terms WHERE contains(t, ' ' || term || ' ')""")
def dictionary_match(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.trim(text.fold(F.col("p_type"))).alias("term"))
    terms = parts.union(spark.createDataFrame([(t,) for t in ("that with", "in the", "stupid", "de la", "eau")], "term string")).distinct()
    return mentions.dictionary_matches(table(spark, d, "documents"), "doc_id", F.col("text"), terms)


_SIG = f""", raw AS (SELECT pos, {S.normal_url('url')} AS url, CASE WHEN game = 'g1' THEN 'one' WHEN game = 'g10' THEN 'ten' ELSE lower(trim(game)) END AS game_key, published_at AS ts,
    {S.keywords("title || ' ' || body_text", PACK.stop, PACK.noise, PACK.events)} AS kw, {S.title_words('title')} AS tw, {S.entities('title', 'body_text', 'game', PACK.entity_stop)} AS en FROM items),
  sig AS (SELECT *, row_number() OVER (ORDER BY ts DESC, pos) AS o FROM raw),
  edges AS (SELECT x.pos AS a, y.pos AS b, x.o AS oa, y.o AS ob, x.game_key = y.game_key AS same_game FROM sig x JOIN sig y ON x.game_key = y.game_key AND x.o < y.o
    WHERE x.url = y.url OR (x.ts - y.ts <= INTERVAL 48 HOUR AND ({S.jaccard('x.kw', 'y.kw')} >= 0.40 OR {S.jaccard('x.tw', 'y.tw')} >= 0.45 OR ({S.jaccard('x.tw', 'y.tw')} >= 0.25 AND {S.jaccard('x.en', 'y.en')} >= 0.50))))"""


@query(_with(f"{_SIG} SELECT a, b FROM edges WHERE same_game"))
def story_edges(spark: SparkSession, d: str) -> DataFrame:
    return cluster.story_edges(cluster.written(cluster.signatures(items_view(spark, d), PACK), "story-signatures")).select("a", "b")


_LEADERS = _with(f"""{_SIG}, before AS (SELECT ob AS o, list(oa) AS prev FROM edges GROUP BY ob),
  nodes AS (SELECT s.o, s.pos, coalesce(b.prev, []) AS prev FROM sig s LEFT JOIN before b USING (o)),
  walk AS (SELECT 0::BIGINT AS o, []::BIGINT[] AS seeds UNION ALL
    SELECT n.o, CASE WHEN len(list_intersect(n.prev, w.seeds)) = 0 THEN list_append(w.seeds, n.o) ELSE w.seeds END FROM walk w JOIN nodes n ON n.o = w.o + 1),
  final AS (SELECT seeds FROM walk ORDER BY o DESC LIMIT 1),
  member AS (SELECT n.pos, CASE WHEN list_contains(seeds, n.o) THEN n.o ELSE list_min(list_intersect(n.prev, seeds)) END AS lo FROM nodes n, final)
  SELECT m.pos, s.pos AS leader FROM member m JOIN sig s ON s.o = m.lo""").replace("WITH items", "WITH RECURSIVE items", 1)


@query(_LEADERS)
def story_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster.cluster(items_view(spark, d), PACK)


@query(_with("""SELECT game, count(*) AS n, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, min(published_at) AS first_at, max(published_at) AS last_at,
  arg_max(pos, (CASE WHEN image_url IS NULL THEN 0 ELSE 1 END, published_at, -pos)) AS representative FROM items GROUP BY game"""))
def cluster_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return items_view(spark, d).groupBy("game").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"),
        F.max_by("pos", F.struct(F.when(F.col("image_url").isNull(), 0).otherwise(1).alias("i"), "published_at", (-F.col("pos")).alias("p"))).alias("representative"),
    )


@query()
def story_representatives(spark: SparkSession, d: str) -> DataFrame:
    return cluster.representatives(items_view(spark, d), PACK).select("pos", "title", "game", "published_at")


def _hits_sql(x: str, signals) -> str:
    t = f"(' ' || trim({x}) || ' ')"
    return f"list_filter({S.words(signals)}, lambda s: contains({t}, ' ' || s || ' ') OR contains({t}, ' ' || s || 's '))"


_TOPIC = _with(f""", t AS (SELECT pos, regexp_replace({S.fold('title')}, '\\b(?:the that)\\b', ' ', 'g') AS ti, {S.fold('url')} AS u, regexp_replace({S.fold('body_text')}, '\\b(?:the that)\\b', ' ', 'g')[1:400] AS b FROM items),
  h AS (SELECT pos, ti || ' ' || u || ' ' || b AS whole, ti || ' ' || u AS head, ti FROM t),
  s AS (SELECT pos, len({_hits_sql('whole', PACK.strong_positive)}) AS sp, len({_hits_sql('whole', PACK.weak_positive)}) AS wp, {_hits_sql('head', PACK.strong_negative)} AS sn, {_hits_sql('head', PACK.weak_negative)} AS wn,
    len({_hits_sql('ti', tuple(PACK.known_titles))}) > 0 AS known FROM h),
  v AS (SELECT *, 2 * sp + wp + CASE WHEN known THEN 2 ELSE 0 END AS p, 2 * len(sn) + len(wn) AS n FROM s)
  SELECT pos, CAST(p AS INT) AS topic_pos, CAST(n AS INT) AS topic_neg, CASE WHEN n > 0 THEN p - n >= 2 ELSE p >= 2 END AS topic_ok,
    CASE WHEN n > 0 AND p - n >= 2 THEN 'positive_over_negative' WHEN n > 0 THEN 'negative:' || list_min(list_concat(sn, wn)) WHEN p < 2 THEN 'too_little' WHEN sp > 0 THEN 'strong_positive' WHEN known THEN 'known_title' ELSE 'several_weak' END AS topic_reason FROM v""")


def _topics(spark: SparkSession, d: str) -> DataFrame:
    return topic.classify(items_view(spark, d).withColumn("feed_categories", F.array().cast("array<string>")), PACK)


@query(_TOPIC)
def topic_score(spark: SparkSession, d: str) -> DataFrame:
    return _topics(spark, d).select("pos", "topic_pos", "topic_neg", "topic_ok", "topic_reason")


@query(f"SELECT topic_reason, count(*) AS n FROM ({_TOPIC}) GROUP BY 1")
def reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    return reports.histogram(_topics(spark, d), "topic_reason")


@query(f"SELECT page_id, nullif(regexp_extract(html, '(?is)<img\\b[^>]*?\\bsrc\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1), '') AS image FROM pages")
def first_image(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", markup.first_image(F.col("html")).alias("image"))


_LINES = "|".join(sorted(markup.BREAKS))


@query(f"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->|<![^>]*>', '', 'gs'), '<(script|style)\\b[^>]*>.*?</(script|style)>', '', 'gs') AS h FROM pages),
  b AS (SELECT page_id, regexp_replace(regexp_replace(h, '</?({_LINES})\\b[^>]*>', chr(10), 'g'), '<[/a-z][^>]*>', '', 'g') AS h FROM a),
  c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '&quot;?', '"', 'g'), '&middot;?', '·', 'g'), '&copy;?', '©', 'g'), '&amp;?', '&', 'g') AS h FROM b)
  SELECT page_id, nullif(array_to_string(list_filter(list_transform(string_split(h, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)), '') AS text FROM c""")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", markup.strip_html("html").alias("text"))


@query("SELECT conv_id, array_to_string(list(role || ': ' || text ORDER BY turn, role, text), chr(10)) AS dialogue, count(*) AS turns FROM conversations GROUP BY conv_id")
def conversation_text(spark: SparkSession, d: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda s: F.concat(s["role"], F.lit(": "), s["text"]))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(lines, "\n").alias("dialogue"), F.count("*").alias("turns"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return topk.within(rows, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], 3)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


@query(_with(f"SELECT pos, round({_MICROS} / 3.6e9, 6) AS age_hours, round(greatest(0.0, least(1.0, 1.0 - {_MICROS} / 3.6e9 / 48.0)), 6) AS recency FROM items"))
def date_math(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("published_at")
    return items_view(spark, d).select("pos", F.round(dates.hours_between(now(), at), 6).alias("age_hours"), F.round(dates.recency(at, now()), 6).alias("recency"))


@query(_with("SELECT pos FROM items WHERE source_type <> 'reddit' EXCEPT ALL SELECT pos FROM items WHERE relevance > 3"))
def rejected_rows(spark: SparkSession, d: str) -> DataFrame:
    items = items_view(spark, d)
    return dedup.minus(items.where("source_type <> 'reddit'"), items.where("relevance > 3"), ["pos"]).select("pos")


@query(_with("SELECT game, pos, published_at FROM (SELECT *, row_number() OVER (PARTITION BY game ORDER BY published_at DESC, pos DESC) AS r FROM items) WHERE r = 1"))
def latest_per_game(spark: SparkSession, d: str) -> DataFrame:
    return joins.latest_of(items_view(spark, d), "game", "published_at").select("game", "pos", "published_at")


@query(_with("SELECT pos, lower(trim(game)) IN ('g1', 'g2', 'g7') AS featured FROM items"))
def featured_flag(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(f,) for f in FEATURED], "name string")
    return joins.featured_flag(items_view(spark, d), names).select("pos", "featured")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1, 2")
def lineitem_summary(spark: SparkSession, d: str) -> DataFrame:
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(revenue, 2).alias("revenue"))


@query("SELECT least(CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) - 1, 14) AS delay, doc_id FROM documents")
def stagger(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, d, "documents").select(F.least(F.row_number().over(w) - 1, F.lit(14)).alias("delay"), "doc_id")


_BROKEN = """, raw AS (SELECT pos, CASE WHEN pos % 13 = 0 THEN ' ' ELSE title END AS title, CASE WHEN pos % 17 = 0 THEN 'ftp://x' ELSE url END AS url, source, source_type,
  CASE WHEN pos % 19 = 0 THEN NULL WHEN pos % 23 = 0 THEN 'x' ELSE source_subreddit END AS source_subreddit, CASE WHEN pos % 29 = 0 THEN NULL ELSE published_at END AS published_at,
  published_at AS fetched_at, CASE WHEN language IN ('es', 'en') THEN language ELSE CASE WHEN pos % 2 = 0 THEN language END END AS language FROM items)"""


_REASON = """SELECT pos, CASE WHEN trim(regexp_replace(title, '^\\s+|\\s+$', '', 'g')) = '' OR title IS NULL THEN 'title_empty' WHEN NOT regexp_matches(url, '^https?://') THEN 'url_not_http'
  WHEN source_type = 'reddit' AND source_subreddit IS NULL THEN 'subreddit_missing' WHEN source_type <> 'reddit' AND source_subreddit IS NOT NULL THEN 'subreddit_unexpected'
  WHEN published_at IS NULL THEN 'published_at_missing' WHEN language IS NOT NULL AND language NOT IN ('es', 'en') THEN 'language_unknown' END AS reject_reason FROM raw"""


def broken_items(spark: SparkSession, d: str) -> DataFrame:
    """Items with faults put in."""
    p = F.col("pos")
    return items_view(spark, d).select(
        "pos", F.when(p % 13 == 0, " ").otherwise(F.col("title")).alias("title"), F.when(p % 17 == 0, "ftp://x").otherwise(F.col("url")).alias("url"), "source", "source_type",
        F.when(p % 19 == 0, F.lit(None)).when(p % 23 == 0, "x").otherwise(F.col("source_subreddit")).alias("source_subreddit"),
        F.when(p % 29 == 0, F.lit(None)).otherwise(F.col("published_at")).alias("published_at"), F.col("published_at").alias("fetched_at"),
        F.when(F.col("language").isin("es", "en") | (p % 2 == 0), F.col("language")).alias("language"),
    )


@query(_with(f"{_BROKEN} {_REASON}"))
def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that each broken item breaks."""
    return broken_items(spark, d).select("pos", raw_reject_reason().alias("reject_reason"))


@query("""WITH featured AS (SELECT n_name AS name, n_nationkey AS ord FROM nation), available AS (SELECT DISTINCT n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 9000),
  logos AS (SELECT n_name AS name, 'logo-' || n_regionkey AS logo FROM nation WHERE n_regionkey = 2)
  SELECT f.name, f.ord, l.logo FROM featured f LEFT JOIN logos l USING (name) WHERE l.logo IS NOT NULL OR f.name IN (SELECT name FROM available)""")
def filter_buttons(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    featured = nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"))
    rich = table(spark, d, "supplier").where("s_acctbal > 9000").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"))
    logos = nation.where("n_regionkey = 2").select(F.col("n_name").alias("name"), F.concat(F.lit("logo-"), F.col("n_regionkey").cast("string")).alias("logo"))
    return joins.buttons(featured, rich, logos)


@query(_with("SELECT source_type, count(*) AS total, count_if(image_url IS NOT NULL) AS with_image, min(title) AS first_title, count(DISTINCT game) AS games FROM items GROUP BY source_type"))
def class_report(spark: SparkSession, d: str) -> DataFrame:
    return items_view(spark, d).groupBy("source_type").agg(
        F.count("*").alias("total"), F.count_if(F.col("image_url").isNotNull()).alias("with_image"), F.min("title").alias("first_title"), F.countDistinct("game").alias("games")
    )


@query(_with(f"""SELECT pos, CAST(floor(len(body_text) / 3) + 320 AS BIGINT) AS tokens, upper(source[1:3]) AS initials, CASE WHEN len(body_text) > 800 THEN substr(body_text, 1, 800) || '...' ELSE body_text END AS cut FROM items"""))
def display_strings(spark: SparkSession, d: str) -> DataFrame:
    body = F.col("body_text")
    return items_view(spark, d).select("pos", text.token_estimate(body).alias("tokens"), text.initials(F.col("source")).alias("initials"), text.truncate(body, 800, "...").alias("cut"))


def _drained(spark: SparkSession, d: str, make: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = stream.file_stream(spark, f"{d}/events.parquet", table(spark, d, "events"))
    return stream.drain(make(stream.with_event_time(events, "ts", "60 days")), mode, f"{base}/out", f"{base}/checkpoint")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts by a stream over the events."""
    got = _drained(spark, d, lambda s: stream.windowed(s, "ts", "1 day", by=("event_type",)), "complete")
    return got.select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("SELECT DISTINCT user_id FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The users that a stream over the events lets through once."""
    return _drained(spark, d, lambda s: stream.once_per_key(s, ["user_id"]).select("user_id"), "append")


@query("SELECT CAST(time_bucket(INTERVAL 12 HOUR, ts) AS TIMESTAMP) AS start, user_id, count(*) AS n FROM events GROUP BY ALL")
def stream_user_windows(spark: SparkSession, d: str) -> DataFrame:
    got = _drained(spark, d, lambda s: stream.windowed(s, "ts", "12 hours", by=("user_id",)), "complete")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


from . import checked, checked_names, checked_state  # noqa: E402, F401  (add their queries)
