"""Rows, ranking, joins, clustering, detection, enrichment, storage, streams and the whole run."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from riffle import domain
from riffle.operators import cluster, detect, enrich, joins, mentions, providers, reports, store, topk
from riffle.operators.filters import by_age, check_patterns
from riffle.plans import digest
from riffle.schema import ITEMS, ITEMS_RAW, raw_reject_reason, split_valid
from riffle.sources import feeds, web
from riffle.streaming import items as stream

NOW = datetime(2024, 1, 10, 12)
PACK = domain.DomainPack.from_dict({
    "strong_positive": ["orbit fleet", "spaceship"], "weak_positive": ["trailer", "update"], "strong_negative": ["movie"], "anchors": ["launches", "gets", "adds", "reveals"],
    "leading_noise": ["new"], "post_name": ["officially"], "generic_tokens": ["studio"], "known_titles": {"orbit fleet": "Orbit Fleet", "comet": "Comet"}, "stop": ["the", "and"],
    "events": ["launch"], "places": ["new york"],
})


def now():
    return F.lit(NOW).cast("timestamp")


def raw(spark, rows):
    base = {f: None for f in ITEMS_RAW.fieldNames()} | {"source": "Daily", "source_type": "media", "published_at": NOW - timedelta(hours=1), "fetched_at": NOW, "feed_categories": [], "language": "en"}
    full = [base | {"pos": i, "title": f"title {i}", "url": f"https://e.org/{i}"} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[f] for f in ITEMS_RAW.fieldNames()) for r in full], ITEMS_RAW)


def test_invalid_rows_are_set_apart(spark):
    df = raw(spark, [{}, {"title": " "}, {"url": "ftp://x"}, {"source_type": "reddit"}, {"source_subreddit": "x"}, {"language": "fr"}, {"published_at": None}])
    good, bad = split_valid(df, raw_reject_reason())
    assert [r.pos for r in good.collect()] == [0]
    assert {r.pos: r.reject_reason for r in bad.collect()} == {1: "title_empty", 2: "url_not_http", 3: "subreddit_missing", 4: "subreddit_unexpected", 5: "language_unknown", 6: "published_at_missing"}


def test_age_window_edges(spark):
    ages = [24, 24 + 1 / 3600, 23.99, -5]
    df = raw(spark, [{"published_at": NOW - timedelta(hours=a)} for a in ages])
    assert sorted(r.pos for r in by_age(df, now(), 24).collect()) == [0, 2, 3]


def _greedy(order, edges):
    adjacent, lead = {frozenset(e) for e in edges}, {}
    for i, x in enumerate(order):
        if x in lead:
            continue
        lead[x] = x
        for y in order[i + 1 :]:
            if y not in lead and frozenset((x, y)) in adjacent:
                lead[y] = x
    return lead


@pytest.mark.parametrize("seed", range(3))
def test_leaders_equal_the_greedy_loop(spark, seed):
    rng = random.Random(seed)
    n, kinds, span = 60, 8, 100
    rows = [(i, f"c{rng.randrange(kinds)}", -rng.randint(0, 450), f"g{rng.randrange(3)}" if seed and rng.random() < 0.15 else None) for i in range(n)]
    similar = {(f"c{i}", f"c{j}") for i in range(kinds) for j in range(i, kinds) if rng.random() < (0.8 if i == j else 0.15)}
    similar |= {(y, x) for x, y in similar}
    order = sorted(range(n), key=lambda i: (rows[i][2], i))
    pairs = {
        (a, b) for k, a in enumerate(order) for b in order[k + 1 :]
        if (rows[a][1], rows[b][1]) in similar and rows[b][2] - rows[a][2] <= span or rows[a][3] is not None and rows[a][3] == rows[b][3]
    }
    table = spark.createDataFrame([(p, c, -r // span, r, g) for p, c, r, g in rows], "pos long, cls string, slot long, rank long, grp string")
    got = cluster.leaders(table, spark.createDataFrame(sorted(similar), "cls string, other string"), span)
    assert {r.pos: r.leader for r in got.collect()} == _greedy(order, pairs)


def test_very_many_alike_rows_of_one_game(spark):
    """A hundred thousand rows that look the same, and a few hundred that are near them, never meet in pairs."""
    n, hours = 100_000, 400
    at = F.timestamp_seconds(F.lit(1_704_000_000) + F.col("id") * (hours * 3600) / n)
    title = F.when(F.col("id") % 1_000 == 7, "alpha beta gamma delta extra").otherwise("alpha beta gamma delta")
    rows = spark.range(n).select(F.col("id").alias("pos"), title.alias("title"), F.concat(F.lit("https://e.org/"), "id").alias("url"), F.lit("g").alias("game"), F.lit("").alias("body_text"), at.alias("published_at"))
    got = cluster.cluster(rows, PACK)
    first = got.groupBy("leader").agg(F.count("*").alias("n"), F.min("pos").alias("low")).orderBy(F.desc("leader")).collect()
    want, top = [], n - 1
    step = 48 * n // hours  # rows within the window of a leader
    while top >= 0:
        want.append((top, min(top, step) + 1))
        top -= step + 1
    assert [(r.leader, r.n) for r in first] == want


def test_stories_are_not_transitive_and_respect_the_window(spark):
    day = [NOW - timedelta(hours=h) for h in (1, 2, 3, 60)]
    rows = [
        {"title": "alpha beta gamma delta", "game": "g", "published_at": day[0]}, {"title": "alpha beta gamma omega", "game": "g", "published_at": day[1]},
        {"title": "other words here now", "game": "g", "published_at": day[2], "image_url": "https://i.org/1"}, {"title": "alpha beta gamma delta", "game": "g", "published_at": day[3]},
        {"title": "alpha beta gamma delta", "game": "h", "published_at": day[0]}, {"title": "zzz", "game": "k", "url": "https://e.org/0/#x"},
    ]
    got = {r.pos: r.leader for r in cluster.cluster(raw(spark, rows), PACK).collect()}
    assert got[1] == 0 and got[2] == 2 and got[3] == 3 and got[4] == 4
    assert got[5] == 0  # the same address, another game


@pytest.mark.parametrize("seed", range(6))
def test_floor_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [{"source_type": rng.choice(["media", "reddit"]), "source_subreddit": None, "relevance": None} for _ in range(rng.randint(5, 40))]
    most, floor = rng.randint(1, 20), rng.randint(0, 10)
    df = raw(spark, [{k: v for k, v in r.items() if k != "relevance"} for r in rows]).withColumn("points", F.lit(0.0) + F.col("pos") % 7)
    got = {r.pos for r in topk.with_floor(df, F.col("points"), most, floor).collect()}
    local = sorted(range(len(rows)), key=lambda i: (-(i % 7), tuple(-ord(c) for c in f"https://e.org/{i}") + (1,), i))
    if len(rows) <= most:
        assert got == set(local)
        return
    picked, rest = local[:most], [i for i in local[most:] if rows[i]["source_type"] == "reddit"]
    while floor > 0 and sum(rows[i]["source_type"] == "reddit" for i in picked) < floor and rest and any(rows[i]["source_type"] != "reddit" for i in picked):
        worst = [i for i in picked if rows[i]["source_type"] != "reddit"][-1]
        picked.remove(worst)
        picked.append(rest.pop(0))
    assert len(got) == len(picked)
    assert sum(rows[i]["source_type"] == "reddit" for i in got) == sum(rows[i]["source_type"] == "reddit" for i in picked)


def test_quotas(spark):
    df = raw(spark, [{"game": "g", "source_type": "reddit"}] * 3 + [{"game": "g"}] * 3 + [{"game": "General"}] * 3).withColumn("relevance", F.lit(1))
    assert topk.per_game(df, 2, ("General",)).count() == 5
    assert topk.per_game(df, 0).count() == 9
    assert topk.per_game_two_quotas(df, 0, None).count() == 3
    assert topk.per_game_two_quotas(df, None, 1).count() == 7


@pytest.mark.parametrize(
    ("title", "want"),
    [
        ("A Comet-like adventure", True), ("This is not Comet", True), ("It isn't Comet at all", True), ("Comet gets a map", False), ("No racing, no Comet", True),
        ("No time, still playing Comet", False), ("A Comet clone", True), ("Comet? Nah", True), ("Comet? No thanks", True), ("A game unlike Comet", True), ("It isn't Mars, Venus or Comet", True),
    ],
)
def test_reference_guard(title, want):
    assert detect.is_reference(title, "Comet", PACK) is want


@pytest.mark.parametrize(
    ("title", "want"),
    [
        ("New Orbit Fleet launches today", ("Orbit Fleet", "anchor")), ("Star Harbor reveals its map", ("Star Harbor", "anchor")), ("I love Comet", ("Comet", "known")),
        ("Why we are still playing Deep Blue Sea", ("Deep Blue Sea", "playing")), ("Velvet Sun mixes cards and dice", ("Velvet Sun", "subject")), ("nothing here", (None, "none")),
        ("Big Studio launches app", (None, "none")),
    ],
)
def test_detection_cascade(title, want):
    assert detect.detect(title, PACK) == want


def test_rules_and_exclusion(spark):
    rules = domain.parse_rules({"include": [{"name": "Orbit Fleet", "aliases": ["OF2"]}, {"name": "Comet"}], "exclude": [{"name": "Badland"}]})
    assert detect.match_rules("Comet gets map", "", rules, PACK) == "Comet"
    assert detect.match_rules("A Comet-like game", "comet and comet", rules, PACK) == "Comet"
    assert detect.match_rules("Comet and Badland", "", rules, PACK) is None
    assert detect.context_matches("A Comet-like game", rules, PACK) == ["Comet"]
    assert detect.mention_count("Comet 2 and Comet", "Comet") == 2
    df = raw(spark, [{"title": "OF2 adds ships"}, {"title": "x", "source_type": "reddit", "source_subreddit": "s"}, {"title": "y", "source_type": "steam", "source": "Steam · Nova"}, {"title": "z"}])
    got = {r.pos: (r.game, r.match_reason) for r in detect.assign_games(df, rules, PACK).collect()}
    assert got == {0: ("Orbit Fleet", "config"), 1: ("Reddit Rumors", "reddit"), 2: ("Nova", "hint"), 3: ("General", "none")}


def test_a_number_after_a_name_is_part_of_the_mention():
    rules = domain.parse_rules({"include": [{"name": "Grand Story", "aliases": ["GS"]}, {"name": "Under", "aliases": ["Under 2"]}], "exclude": [{"name": "Fort"}]})
    match = lambda title, body="": detect.match_rules(title, body, rules, PACK)
    assert match("GS 6 trailer is out") == "Grand Story" and match("Under 2 gets a release date") == "Under"
    assert match("Fort 2 and Under out") is None and match("Under out", "fort 24 has news") is None
    assert match("GS 6? No thanks") is None and match("GS 6? Nah. Under 2 it is") == "Under"
    assert match("News", "under 2 is out") is None and match("News", "under 2 is out, under 3 isn't") == "Under"
    assert detect.context_matches("GS 6? No thanks", rules, PACK) == ["Grand Story"]
    assert detect.known_titles("Comet 4 development news", PACK) == ["Comet"] and detect.detect("Comet 4 development news", PACK) == ("Comet", "known")


def test_automaton_finds_what_a_scan_finds():
    rng = random.Random(3)
    for _ in range(200):
        phrases = [" ".join(rng.choices("ab c".split(), k=rng.randint(1, 4))) for _ in range(rng.randint(0, 6))] + [""]
        words = rng.choices(["ab", "c", "x"], k=rng.randint(0, 30))
        want = sorted((i, i + len(p.split()), n) for n, p in enumerate(phrases) for i in range(len(words)) if p and words[i : i + len(p.split())] == p.split())
        assert sorted(mentions.Automaton(phrases).find(words)) == want


def test_matches_beyond_the_broadcast_are_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["The Big, bad wolf", "badly", None, "", "big bad bad"])], "id long, t string")
    terms = spark.createDataFrame([("big bad",), ("wolf",), ("bad",), ("!",), (None,), ("Bad",)], "term string")
    few = {tuple(r) for r in mentions.dictionary_matches(df, "id", F.col("t"), terms).collect()}
    monkeypatch.setattr(mentions, "MOST_PHRASES", 2)
    assert few == {tuple(r) for r in mentions.dictionary_matches(df, "id", F.col("t"), terms).collect()} == {(0, "big bad"), (0, "wolf"), (0, "bad"), (0, "Bad"), (4, "big bad"), (4, "bad"), (4, "Bad")}
    with pytest.raises(ValueError):
        mentions.mentions(df, "id", F.col("t"), terms)


def test_folding_of_decomposed_letters(spark):
    from riffle.functions.text import fold, fold_py

    texts = ["cafe\u0301s", "ca\u0301fe", "Vi\u1ec7t nam", "\u212bngstro\u0308m", "a\u064eb", "e\u0301", "ñandú", "日本 x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(fold(F.col("t")).alias("f")).collect()
    assert [r.f for r in rows] == [fold_py(t) for t in texts] and rows[0].f == "cafes"


def test_dictionary_matches(spark):
    df = spark.createDataFrame([(1, "The Big, bad wolf"), (2, "badly"), (3, None)], "id long, t string")
    terms = spark.createDataFrame([("big bad",), ("wolf",), ("bad",)], "term string")
    assert {tuple(r) for r in mentions.dictionary_matches(df, "id", F.col("t"), terms).collect()} == {(1, "big bad"), (1, "wolf"), (1, "bad")}


@pytest.mark.parametrize(
    "bad",
    [
        [], {"include": [{"name": ""}]}, {"include": [{"name": "a", "aliases": [3]}]}, {"include": [{"name": "a", "platform": ["toaster"]}]}, {"include": [{"name": "É"}], "exclude": [{"name": "e"}]},
    ],
)
def test_bad_rules(bad):
    with pytest.raises(domain.ConfigError):
        domain.parse_rules(bad)


@pytest.mark.parametrize(
    "bad",
    [
        {"media": [{"name": "a", "feed": "ftp://x", "language": "en"}]}, {"media": [{"name": "a", "feed": "https://x", "language": "fr"}]}, {"steam": {"games": [{"app_id": 0, "name": "x"}]}},
        {"steam": {"enabled": "yes"}}, {"limits": {"per_feed": -1}}, {"quality": {"title_patterns": ["("]}},
    ],
)
def test_bad_sources(bad):
    with pytest.raises(domain.ConfigError):
        domain.parse_sources(bad)


def test_patterns_must_suit_the_engine(spark):
    """Python's reader takes (?P<x>..); the engine doesn't."""
    given = domain.parse_sources({"quality": {"title_patterns": ["(?P<word>ad)"], "url_patterns": ["^ok$"]}})
    check_patterns(spark, *given.url_patterns)
    with pytest.raises(domain.ConfigError, match="word"):
        check_patterns(spark, *given.title_patterns)


def test_sources_and_yaml(tmp_path):
    (tmp_path / "s.yaml").write_text("media: [{name: A, feed: 'https://a.org/f', language: en}]\nreddit: {enabled: false, subreddits: [{name: x}]}\nlimits: {per_feed: 3}\n")
    s = domain.parse_sources(domain.load_yaml(str(tmp_path / "s.yaml")))
    assert s.media[0].name == "A" and s.subreddits == () and s.limits.per_feed == 3 and s.limits.per_game == 8
    with pytest.raises(domain.ConfigError):
        domain.load_yaml(str(tmp_path / "none.yaml"))
    (tmp_path / "b.yaml").write_text("a: [")
    with pytest.raises(domain.ConfigError):
        domain.load_yaml(str(tmp_path / "b.yaml"))


RSS = """<rss xmlns:media="http://m"><channel>
<item><title>Orbit Fleet adds ships</title><link>https://e.org/1</link><pubDate>Wed, 10 Jan 2024 10:00:00 GMT</pubDate><description><![CDATA[<p>A  b</p><img src="https://i.org/x.png">]]></description><category>News</category></item>
<item><title>No link</title></item>
<item><title>Two</title><link>https://e.org/2</link><pubDate>Tue, 01 Jan 2030 10:00:00 GMT</pubDate><enclosure url="https://i.org/2.jpg" type="image/jpeg"/><description>t</description></item>
</channel></rss>"""
ATOM = """<feed><entry><title>Rumor</title><link href="https://r.org/1"/><updated>2024-01-10T09:00:00Z</updated><author><name>u</name></author><content type="html">&lt;p&gt;hello&lt;/p&gt;</content></entry>
<entry><title>x</title></entry></feed>"""
STEAM = {"appnews": {"appid": 5, "newsitems": [{"gid": "1", "title": "Patch", "url": "https://s.org/1", "contents": "<b>fix</b>", "date": 1704880800}, {"title": "", "url": "https://s.org/2"}]}}


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text(ATOM)
    (tmp_path / "c.json").write_text(json.dumps(STEAM))
    (tmp_path / "d.json").write_text("[]")
    lost = []
    landed = [
        feeds.Landed(str(tmp_path / "b.xml"), "r/orbit", "reddit", subreddit="orbit"), feeds.Landed(str(tmp_path / "c.json"), "Nova", "steam", app_id=5),
        feeds.Landed(str(tmp_path / "a.xml"), "Daily", "media", "en"), feeds.Landed(str(tmp_path / "d.json"), "Bad", "steam", app_id=6),
    ]
    rows = feeds.read_all(spark, landed, now(), lambda f, e: lost.append(f.source)).orderBy("pos").collect()
    assert [r.title for r in rows] == ["Orbit Fleet adds ships", "Two", "Patch", "Rumor"]
    assert lost == ["Bad"]
    assert rows[0].body_text == "A b" and rows[0].image_url == "https://i.org/x.png" and rows[0].feed_categories == ["News"]
    assert rows[1].published_at == NOW and rows[1].image_url == "https://i.org/2.jpg"
    assert rows[2].source == "Steam · Nova" and rows[2].game_id == "5" and rows[2].body_text == "fix"
    assert rows[3].body_text == "hello" and rows[3].author == "u" and rows[3].language is None and rows[3].source_subreddit == "orbit"


def test_bad_feeds_stop_no_other(spark, tmp_path):
    """Missing, cut and empty files of every kind beside good ones: each is reported, good rows stay."""
    good = {"rss": RSS, "atom": ATOM, "steam": json.dumps(STEAM)}
    (tmp_path / "two").mkdir()
    for i in range(2):
        (tmp_path / "two" / f"part-{i}.xml").write_text(f"<rss><channel><item><title>T{i}</title><link>https://two.org/{i}</link></item></channel></rss>")
    landed = [feeds.Landed(str(tmp_path / "two"), "Two", "media", "en", limit=1)]
    for name, text in good.items():
        for kind, body in (("good", text), ("cut", text[: len(text) // 2]), ("other", "plain"), ("none", "")):
            (tmp_path / f"{name}-{kind}").write_text(body)
            landed.append(feeds.Landed(str(tmp_path / f"{name}-{kind}"), f"{name}-{kind}", {"rss": "media", "atom": "reddit", "steam": "steam"}[name], subreddit="s" if name == "atom" else None))
        landed.append(feeds.Landed(str(tmp_path / f"{name}-gone"), f"{name}-gone", {"rss": "media", "atom": "reddit", "steam": "steam"}[name], subreddit="s" if name == "atom" else None))
    lost = []
    rows = feeds.read_all(spark, landed, now(), lambda f, e: lost.append(f.source)).collect()
    assert sorted((r.source, r.title) for r in rows) == [("Steam · steam-good", "Patch"), ("Two", "T0"), ("atom-good", "Rumor"), ("rss-good", "Orbit Fleet adds ships"), ("rss-good", "Two")]
    assert len({r.pos for r in rows}) == len(rows)
    bad = {f"{n}-{k}" for n in good for k in ("cut", "other", "none", "gone")}
    assert set(lost) <= bad and {x for x in bad if not x.startswith("rss")} | {"rss-gone"} <= set(lost)
    lost.clear()
    only = [f for f in landed if f.kind == "steam" and "good" not in f.source] + [landed[0]]
    assert len(feeds.read_all(spark, only, now(), lambda f, e: lost.append((f.source, str(e)))).collect()) == 1
    assert lost[-1] == (only[0].source, "no app could be read")


def test_http_retry():
    waits, turns = [], []

    class Answer:
        status = 200

        def read(self):
            return b"x"

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

    def opener(req, timeout):
        turns.append(1)
        if len(turns) == 1:
            raise web.urllib.error.HTTPError("u", 429, "", {"Retry-After": "7"}, None)
        return Answer()

    assert web.fetch("https://e.org", 1, opener, waits.append) == (200, b"x") and waits == [7.0]
    assert web.retry_delay({"x-ratelimit-reset": "200"}) == 60.0 and web.retry_delay({}) == 5.0
    assert web.retry_delay({"Retry-After": "Thu, 01 Jan 1970 00:00:30 GMT"}, now=lambda: 10.0) == 20.0 and web.retry_delay({"x-ratelimit-reset-tokens": "2", "Retry-After": "9"}) == 3.0


def _doc(*rows):
    base = {"title": "t", "summary": "s", "url": "https://e.org/1", "source": "Daily", "source_type": "media", "game": "g", "language": "en", "published_at": "2024-01-10T10:00:00Z", "fetched_at": "2024-01-10T11:00:00Z", "relevance": 3, "category": "rumor", "is_verified": True}
    return json.dumps({"generated_at": "x", "total": len(rows), "news": [{k: v for k, v in (base | r).items() if v != "-"} for r in rows]})


def test_old_documents_are_migrated(spark, tmp_path):
    (tmp_path / "n.json").write_text(_doc(
        {}, {"url": "https://e.org/2", "source": {"name": "Steam ┬À Nova", "type": "steam"}, "fetched_at": "-", "is_verified": "-"}, {"url": "https://e.org/3", "source": "from r/orbit", "source_type": "reddit", "image_url": "https://i.org/1"},
        {"title": None}, {"relevance": "3"}, {"published_at": "2024-01-10T10:00:00"}, {"id": "0" * 16}, {"game": 7}, {"source": ["x"]}, {"title": "canción".encode().decode("cp850"), "url": "https://e.org/4"},
    ))
    good, bad = store.load(spark, str(tmp_path / "n.json"))
    rows = {r.url[-1]: r for r in good.collect()}
    assert set(rows) == {"1", "2", "3", "4"} and bad.count() == 6
    assert rows["2"].source == "Steam · Nova" and rows["2"].source_type == "steam" and rows["2"].is_verified and rows["2"].fetched_at == datetime(2024, 1, 10, 10)
    assert rows["3"].source_subreddit == "orbit" and rows["3"].image == "https://i.org/1"
    assert rows["4"].title == "canción" and rows["1"].game_origin == "matcher"


def test_missing_and_corrupt_documents_are_empty(spark, tmp_path):
    (tmp_path / "c.json").write_text("{")
    for name in ("none.json", "c.json"):
        good, bad = store.load(spark, str(tmp_path / name))
        assert good.count() == 0 and bad.count() == 0


def _items(spark, rows):
    base = {f: None for f in ITEMS.fieldNames()} | {"source": "Daily", "source_type": "media", "game": "g", "game_origin": "matcher", "language": "en", "published_at": NOW - timedelta(hours=1), "fetched_at": NOW, "relevance": 3, "category": "rumor", "is_verified": True, "summary_is_fallback": False}
    full = [base | {"id": f"{i:016x}", "title": f"t{i}", "url": f"https://e.org/{i}", "summary": f"s{i}"} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([(i, *(r[f] for f in ITEMS.fieldNames())) for i, r in enumerate(full)], "pos long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ITEMS.fields))


def test_store_merges_publishes_and_is_idempotent(spark, tmp_path):
    st = store.Store(spark, f"file://{tmp_path}/state")
    assert st.history() is None
    st.save(_items(spark, [{}, {"published_at": NOW - timedelta(hours=30)}]), now())
    assert st.history().count() == 2 and st.published().count() == 1
    again = _items(spark, [{"summary": None, "summary_is_fallback": True, "relevance": 5}])
    for _ in range(2):
        out = st.save(again, now())
        assert [(r.summary, r.relevance) for r in out.collect()] == [("s0", 5)]
    doc = json.loads(_text(st._last()["document"]))
    assert doc["total"] == 1 and doc["generated_at"] == "2024-01-10T12:00:00Z" and doc["news"][0]["summary"] == "s0" and "source_subreddit" not in doc["news"][0] and doc["news"][0]["author"] is None
    assert digest.read(st, "g", "rumors").count() == 1 and digest.read(st, "g", "news").count() == 0


def test_a_run_between_is_a_conflict(spark, tmp_path, monkeypatch):
    st = store.Store(spark, f"file://{tmp_path}/state")
    st.save(_items(spark, [{}]), now())
    before, first = st._last(), st.published().collect()
    ends = store.write_document

    def meanwhile(*args):
        ends(*args)
        monkeypatch.undo()
        st.save(_items(spark, [{}, {}]), now())

    monkeypatch.setattr(store, "write_document", meanwhile)
    with pytest.raises(store.Conflict):
        st.save(_items(spark, [{}, {}, {}]), now())
    assert st._last()["seq"] == before["seq"] + 1 and st.published().count() == 2 and len(first) == 1
    # Two runs that have both passed the first test and take the same number: one is named, the other is told.
    base, one, two = st._last(), store.Store(spark, st.base), store.Store(spark, st.base)
    entry = base | {"seq": base["seq"] + 1}
    monkeypatch.setattr(two, "_last", lambda: base)
    one._point(base, entry | {"document": "one"})
    with pytest.raises(store.Conflict):
        two._point(base, entry | {"document": "two"})
    assert st._last()["document"] == "one"
    assert not [n for n in st.files.names(f"{st.base}/pointer") if not n[0].isdigit() and not n.endswith(".crc")]


def test_a_save_rewrites_the_buckets_of_its_rows(spark, tmp_path):
    st = store.Store(spark, f"file://{tmp_path}/state", buckets=32, keep=2)
    st.save(_items(spark, [{}] * 400), now())
    first = st._last()
    assert len(first["buckets"]) == 32
    few = _items(spark, [{"summary": "new"}] * 4)
    st.save(few, now())
    second = st._last()
    moved = {b for b in second["buckets"] if second["buckets"][b] != first["buckets"].get(b)}
    want = {str(r[0]) for r in few.select(F.pmod(F.xxhash64("id"), F.lit(32))).distinct().collect()}
    assert moved == want and len(want) <= 4
    assert st.history().count() == 400 and st.history().where("summary = 'new'").count() == 4 and st.history(0).where("summary = 'new'").count() == 0
    # The first version's folder still holds the other buckets; a version that nothing names goes.
    st.save(_items(spark, [{"summary": "all"}] * 400), now())
    st.save(_items(spark, [{"summary": "all"}] * 400), now())
    assert len(st.files.names(f"{st.base}/versions")) == 2 and st.history(0) is None and st.history().where("summary = 'all'").count() == 400


@pytest.mark.parametrize("counted_off", [False, True])
def test_retention_holds_for_buckets_that_were_not_rewritten(spark, tmp_path, monkeypatch, counted_off):
    if counted_off:
        monkeypatch.setattr(store, "_SORTED_MOST", 10)
    st = store.Store(spark, f"file://{tmp_path}/state", buckets=16)
    rng, at = random.Random(6), F.lit(NOW).cast("timestamp")
    known = {}
    for k in range(4):
        ids = rng.sample(range(300), 60)
        rows = [{"id": f"{i:016x}", "url": f"https://e.org/{i}", "published_at": NOW - timedelta(minutes=rng.randint(0, 4_000)), "source_type": "reddit" if i % 9 == 0 else "media"} for i in ids]
        frame = _items(spark, rows)
        st.save(frame, at + F.expr(f"INTERVAL {k} HOURS"), history_hours=48, history_most=100)
        known |= {r["id"]: (r["published_at"], pos, r["source_type"]) for pos, r in enumerate(rows)}
        floor = NOW + timedelta(hours=k) - timedelta(hours=48)
        known = {i: r for i, r in known.items() if r[0] >= floor}
        media = sorted((i for i, r in known.items() if r[2] == "media"), key=lambda i: (known[i][0], -known[i][1], i), reverse=True)
        known = {i: r for i, r in known.items() if r[2] == "reddit" or i in set(media[:100])}
        assert {r.id for r in st.history().select("id").collect()} == set(known)
    assert len(st._last()["cuts"]) <= 5


def test_a_store_begins_with_the_document_it_is_given(spark, tmp_path):
    (tmp_path / "old.json").write_text(_doc({"summary": "known", "url": "https://e.org/0?utm_source=q", "title": "Orbit Fleet adds spaceship trailer"}))

    class Silent:
        def answer(self, *row):
            raise AssertionError("asked")

    st = store.Store(spark, f"file://{tmp_path}/state")
    out, _ = digest.run(spark, raw(spark, [{"title": "Orbit Fleet adds spaceship trailer", "url": "https://e.org/0"}, {"title": " "}]), now(), domain.Sources(), domain.Rules((), ()), PACK, st, lambda: providers.Fallback(Silent()), seed=str(tmp_path / "old.json"))
    assert [(r.summary, r.summary_is_fallback) for r in out.collect()] == [("known", False)]
    assert [(r.title, r.reject_reason) for r in st.rejects().collect()] == [(" ", "title_empty")]


def test_document_of_nothing_and_of_ties(spark, tmp_path):
    for n in (0, 1, 3, 500):
        path = f"file://{tmp_path}/document{n}"
        store.write_document(_items(spark, [{}] * n), now(), path)
        doc = json.loads(_text(path))
        assert doc["total"] == n and [r["title"] for r in doc["news"]] == [f"t{i}" for i in range(n)]
        places = store.read_document(spark, path).select("pos", F.try_variant_get("raw", "$.title", "string").alias("t")).collect()
        assert sorted((r.pos, r.t) for r in places) == [(i, f"t{i}") for i in range(n)]


def _text(path):
    """The files of a document, one after the other."""
    folder = Path(path.removeprefix("file://"))
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_numbers_without_gaps(spark):
    from riffle.operators.ordered import numbered

    rows = spark.range(1_000).select((F.col("id") * 37 % 100).alias("k"), F.col("id").alias("v"))
    got = numbered(rows, [F.desc("k"), F.asc("v")], "place", 5).orderBy("place").collect()
    assert [r.place for r in got] == list(range(5, 1_005)) and [(-r.k, r.v) for r in got] == sorted((-r.k, r.v) for r in got)
    assert numbered(rows.limit(0), [F.asc("k")]).count() == 0


class Flaky:
    def __init__(self, outs):
        self.outs = list(outs)

    def answer(self, *row):
        out = self.outs.pop(0)
        if isinstance(out, Exception):
            raise out
        return out


GOOD = json.dumps({"summary": "s", "relevance": 3, "category": "rumor", "language": "en"})
ROW = ("t", "b", None, "g", "media")


def test_fallback_switches_after_three_bad_answers():
    f = providers.Fallback(Flaky(["x", GOOD, "x", "{}", "[1]"]), Flaky([GOOD, "x", providers.Unreachable()]))
    assert [f(ROW) for _ in range(4)] == [None, GOOD, None, None]
    assert f(ROW) == GOOD and f.switched
    assert f(ROW) is None
    with pytest.raises(providers.Unreachable):
        f(ROW)


@pytest.mark.parametrize("change", [{"summary": " "}, {"summary": 5}, {"relevance": 9}, {"relevance": True}, {"relevance": 2.5}, {"category": "other"}, {"category": None}, {"language": "fr"}, {"language": None}])
def test_an_answer_with_a_wrong_field_is_bad(spark, change):
    """Both twins refuse it, and three of them in a row switch."""
    raw = json.dumps(json.loads(GOOD) | change)
    with pytest.raises(providers.BadOutput):
        providers.check(raw, "media")
    f = providers.Fallback(Flaky([raw] * 3), Flaky([GOOD]))
    assert [f(ROW), f(ROW), f(ROW)] == [None, None, GOOD] and f.switched
    if not isinstance(change.get("summary"), int):
        row = enrich.validated(spark.createDataFrame([(0, raw, "media")], "pos long, raw string, source_type string")).first()
        assert row.ai is None and row.ai_reason


def test_good_answers_pass():
    assert providers.check("<think>{}</think> Sure: " + GOOD.replace("3", '" 4 "') + " bye", "media")["relevance"] == " 4 "
    assert providers.check(GOOD.replace("rumor", "other"), "reddit")


def test_chat_provider():
    outs = [(429, {"Retry-After": "3"}, ""), (400, {}, "json_validate_failed"), (200, {}, "no json"), (200, {}, GOOD), (0, {}, "")]
    slept, sent = [], []
    chat = providers.Chat(lambda p: (sent.append(p), outs.pop(0))[1], "m", sleep=slept.append)
    assert chat.answer(*ROW) == GOOD
    assert slept == [3.0] and "response_format" in sent[0] and "response_format" not in sent[2]
    schema = sent[0]["response_format"]["json_schema"]
    assert schema["strict"] and set(schema["schema"]["required"]) == set(schema["schema"]["properties"]) == {"summary", "relevance", "category", "language", "game"}
    with pytest.raises(providers.Unreachable):
        chat.answer(*ROW)
    assert "response_format" in sent[-1]  # the schema was left off for that row only


@pytest.mark.parametrize(("outs", "error"), [
    ([(400, {}, "json_validate_failed")] * 2, providers.BadOutput), ([(429, {}, "")] * 6, providers.BadOutput), ([(200, {}, "x")] * 2, providers.BadOutput),
    ([(400, {}, "other")], providers.Unreachable), ([(500, {}, "")], providers.Unreachable),
])
def test_failures_of_a_row_and_of_a_provider(outs, error):
    with pytest.raises(error):
        providers.Chat(lambda p: outs.pop(0), "m", sleep=lambda s: None).answer(*ROW)
    assert not outs


def test_local_provider():
    outs, sent = [(200, "no"), (200, GOOD), (200, "no"), (200, "{}"), (0, "")], []
    local = providers.Local(lambda p: (sent.append(p), outs.pop(0))[1], "small")
    assert local.answer(*ROW) == GOOD and sent[0]["format"] == "json" and sent[0]["prompt"] == providers.instruction("t", "b", "g")
    with pytest.raises(providers.BadOutput):
        local.answer(*ROW)
    with pytest.raises(providers.Unreachable):
        local.answer(*ROW)


def test_the_first_call_picks_the_model():
    sent = []
    post = lambda p: (sent.append(p["model"]), (200, {}, GOOD))[1]
    for offered, want in ((["b", "a", "second"], "second"), (["z-chat", "a-whisper"], "z-chat"), (["first", "second"], "first"), ([], "first")):
        chat = providers.Chat(post, "first", models=lambda offered=offered: offered, preferred=("second",))
        chat.answer(*ROW)
        chat.answer(*ROW)
        assert sent[-2:] == [want, want]

    def broken():
        raise OSError

    providers.Chat(post, "first", models=broken).answer(*ROW)
    assert sent[-1] == "first"


def test_limiter_sleeps_until_the_oldest_leaves():
    t = [0.0]
    lim = providers.Limiter(100, clock=lambda: t[0], sleep=lambda s: t.__setitem__(0, t[0] + s))
    assert lim.wait(50) == 0
    t[0] = 10.0
    assert lim.wait(40) == 50.0


def test_answers_are_checked(spark):
    good = {"summary": " s ", "relevance": "4", "category": "analisis", "language": "en", "game": "Comet"}
    raws = [json.dumps(good), json.dumps(good | {"relevance": 6}), json.dumps(good | {"category": "x"}), "no", None, json.dumps(good | {"summary": " "}), "<think>x</think>```json" + json.dumps(good) + "```"]
    df = spark.createDataFrame([(i, r, "media") for i, r in enumerate(raws)] + [(9, json.dumps(good | {"category": "x"}), "reddit")], "pos long, raw string, source_type string")
    got = {r.pos: (r.ai_reason, r.ai) for r in enrich.validated(df).collect()}
    assert [got[i][0] for i in range(7)] == [None, "relevance_invalid", "category_invalid", "no_json", "no_answer", "summary_missing", None]
    assert got[0][1].summary == "s" and got[0][1].relevance == 4 and got[9][1].category == "rumor"


def test_whole_run_twice(spark, tmp_path):
    rules = domain.parse_rules({"include": [{"name": "Orbit Fleet"}], "exclude": [{"name": "Badland"}]})
    rows = [{"title": "Orbit Fleet adds spaceship trailer", "body_text": "Ships. More."}, {"title": "Movie night"}, {"title": "Badland spaceship"}, {"title": "talk", "source_type": "reddit", "source_subreddit": "o", "source": "r/o"}, {"title": "old spaceship", "published_at": NOW - timedelta(days=3)}, {"title": "Orbit Fleet adds spaceship trailer", "url": "https://e.org/0?utm_source=q"}]
    st = store.Store(spark, f"file://{tmp_path}/run")
    make = lambda: providers.Fallback(providers.Extractive())
    out, funnel = digest.run(spark, raw(spark, rows), now(), domain.Sources(), rules, PACK, st, make)
    got = sorted((r.title, r.game, r.category, r.is_verified) for r in out.collect())
    assert got == [("Orbit Fleet adds spaceship trailer", "Orbit Fleet", "rumor", True), ("talk", "Reddit Rumors", "rumor", False)]
    counts = {r.stage: r.total for r in funnel.collect()}
    assert counts["valid"] == 6 and counts["young"] == 5 and counts["stories"] == 2

    def broken():
        return providers.Fallback(Flaky([]))

    again, _ = digest.run(spark, raw(spark, rows), now(), domain.Sources(), rules, PACK, st, broken)  # all from the cache
    assert sorted((r.title, r.game, r.category, r.is_verified) for r in again.collect()) == got


@pytest.mark.parametrize("rows", [[], [{"title": " "}]])
def test_a_run_over_nothing(spark, tmp_path, rows):
    """No rows, or no valid ones: all stages are counted, the document is empty, and a second run follows."""
    st = store.Store(spark, f"file://{tmp_path}/run")
    given = raw(spark, rows) if rows else raw(spark, [{"title": "x"}]).limit(0)
    for _ in range(2):
        out, funnel = digest.run(spark, given, now(), domain.Sources(), domain.Rules((), ()), PACK, st, lambda: providers.Fallback(providers.Extractive()))
        counts = {r.stage: r.total for r in funnel.collect()}
        assert out.count() == 0 and counts["raw"] == len(rows) and counts["valid"] == counts["enriched"] == 0
        assert st.rejects().count() == len(rows) and st.history() is None and json.loads(_text(st._last()["document"]))["total"] == 0


def test_guard(spark):
    df = spark.createDataFrame([("fallback",)] * 3, "outcome string")
    with pytest.raises(reports.AllFailed):
        reports.guard(df)
    reports.guard(df.limit(2))


def test_streams_agree_with_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = tmp_path / "in"
    events.repartition(3).write.parquet(str(folder))
    s = stream.with_event_time(stream.file_stream(spark, str(folder), events), "ts", "60 days")
    counts = stream.drain(stream.windowed(s, "ts", "1 day", by=("event_type",), value="value"), "complete", str(tmp_path / "o1"), str(tmp_path / "c1"))
    batch = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    assert {(r.start, r.event_type, r.n) for r in counts.collect()} == {(r.w.start, r.event_type, r.n) for r in batch.collect()}
    once = stream.drain(stream.once_per_key(s, ["user_id"]).select("user_id"), "append", str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert once.count() == events.select("user_id").distinct().count()


def test_stream_upsert(spark, tmp_path):
    rows = _items(spark, [{}, {}])
    rows.write.parquet(str(tmp_path / "in"))
    st = store.Store(spark, f"file://{tmp_path}/s")
    q = stream.upsert_into(stream.file_stream(spark, str(tmp_path / "in"), rows), st, now(), str(tmp_path / "c"))
    q.awaitTermination()
    assert st.published().count() == 2
