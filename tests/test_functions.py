from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from riffle.functions import dates, markup, text, urls


def one(spark, expr, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTPS://Example.ORG/A/b/?utm_source=z&p=1&FBCLID=3#top", "https://example.org/A/b?p=1"),
        ("https://example.org/", "https://example.org"),
        ("https://example.org/a//?ref=x", "https://example.org/a"),
        ("  https://example.org/a?q=1&b=2  ", "https://example.org/a?q=1&b=2"),
        ("https://example.org/a?b", "https://example.org/a?b"),
    ],
)
def test_normal_url(spark, raw, want):
    assert one(spark, urls.normal_url(F.col("x")), raw) == want


def test_ids_ignore_tracking(spark):
    a, b = (one(spark, urls.stable_id(F.col("x")), u) for u in ("https://e.org/x?utm_medium=a", "https://E.org/x/#y"))
    assert a == b and len(a) == 16


def test_section_of_request(spark):
    assert one(spark, urls.section_of(F.col("x")), "https://e.org/?game=g&section=rumors") == "rumors"
    assert one(spark, urls.section_of(F.col("x")), "https://e.org/?section=zzz") == "all"


@pytest.mark.parametrize(("raw", "want"), [("Ünïcode, «Ñandú» 3.5!", "unicode nandu 3 5 "), ("", ""), ("...", " ")])
def test_fold(spark, raw, want):
    assert one(spark, text.fold(F.col("x")), raw) == want
    assert text.fold_py(raw) == want


def test_normal_title_deletes_apostrophes(spark):
    assert one(spark, text.normal_title(F.col("x")), " It’s Léo's  ship! ") == "its leos ship"


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [(["a", "b"], ["a", "b"], 1.0), (["a"], ["b"], 0.0), (["a", "b"], ["b", "c"], 1 / 3), ([], [], 0.0), ([], ["a"], 0.0)],
)
def test_jaccard(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(text.jaccard(F.col("a"), F.col("b")).alias("j")).first()["j"] == pytest.approx(want)


def test_keywords_put_events_first(spark):
    got = one(spark, text.keywords(F.col("x"), ["the"], ["old"], ["launch"]), "The old zebra launch, launch of a comet")
    assert got == ["launch", "comet", "zebra"]


def test_entities(spark):
    df = spark.createDataFrame([("Orbit Fleet adds NASA map", "patch 1.2.3 by NASA and ESA", "Orbit Fleet")], "t string, b string, g string")
    got = df.select(text.entities(F.col("t"), F.col("b"), F.col("g"), ["esa"]).alias("e")).first()["e"]
    assert got == ["1.2.3", "nasa"]


@pytest.mark.parametrize(("raw", "want"), [('  "Orbit  Fleet". ', "Orbit Fleet"), ("Unknown", ""), (None, ""), ("a b c d e f g", ""), ("x" * 49, "")])
def test_clean_name(spark, raw, want):
    assert one(spark, text.clean_name(F.col("x"), ("unknown",)), raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("<think>hm</think>{}", "{}"), ("a <think>open", "a"), ("```json\n{}\n```", "{}"), ("<|channel|>x<|channel|>final<|message|>{}", "{}")],
)
def test_strip_reasoning(spark, raw, want):
    assert one(spark, text.strip_reasoning(F.col("x")), raw) == want


def test_alias_key_takes_the_longest(spark):
    aliases = {"orbit": "o", "orbit fleet": "of"}
    assert one(spark, text.alias_key(F.col("x"), aliases), "Orbit Fleet 2") == "of"
    assert one(spark, text.alias_key(F.col("x"), aliases), " Other ") == "other"


def test_small_display_functions(spark):
    assert one(spark, text.initials(F.col("x")), "Steam · Orbit") == "STE"
    assert one(spark, text.initials(F.col("x")), "The Daily Comet News") == "TDC"
    assert one(spark, text.escape_html(F.col("x")), "<a&'>") == "&lt;a&amp;&#39;&gt;"
    assert one(spark, text.excerpt(F.col("x"), 3), "a  bcd") == "a b…"
    assert one(spark, text.excerpt(F.col("x")), None) == "(empty)"
    assert one(spark, text.age_label(F.lit(7500))) == "2h05m"
    assert one(spark, text.subreddit_of(F.col("x")), "posts of r/Orbit_1") == "Orbit_1"
    assert one(spark, text.strip_possessive(F.col("x")), "Orbit’s") == "Orbit"
    assert one(spark, text.token_estimate(F.col("x")), "abcdef") == 322


def test_dates(spark):
    assert one(spark, dates.rfc822(F.col("x")), "Tue, 02 Jan 2024 10:00:00 GMT") == datetime(2024, 1, 2, 10)
    assert one(spark, dates.rfc822(F.col("x")), "2 Jan 2024 10:00:00 +0200") == datetime(2024, 1, 2, 8)
    assert one(spark, dates.rfc822(F.col("x")), "soon") is None
    assert one(spark, dates.epoch(F.col("x")), 0, "long") is None
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    far, near = (F.lit(t).cast("timestamp") for t in ("2024-01-03 00:00:01", "2024-01-03 00:00:00"))
    none = F.lit(None).cast("timestamp")
    assert one(spark, dates.resolve(far, none, now)) == datetime(2024, 1, 2)
    assert one(spark, dates.resolve(none, near, now)) == datetime(2024, 1, 3)
    assert one(spark, dates.resolve(none, none, now)) == datetime(2024, 1, 2)
    assert one(spark, dates.recency(near, now)) == 1.0
    assert one(spark, dates.hours_between(near, now)) == 24.0


def test_html(spark):
    assert one(spark, markup.strip_html(F.col("x")), "<p>a  b<br>c</p><script>x</script>&amp;") == "a b\nc\n&"
    assert one(spark, markup.strip_html(F.col("x")), "<p> </p>") is None
    assert one(spark, markup.first_image(F.col("x")), '<IMG alt="" src="https://i.org/a.png"><img src="https://i.org/b.png">') == "https://i.org/a.png"
    assert one(spark, markup.first_image(F.col("x")), '<img src="data:x"><img src="https://i.org/b.png">') is None
    assert one(spark, markup.unescape(F.col("x")), "&lt;p&gt;") == "<p>"


def test_mojibake():
    broken = "canción".encode().decode("cp850")
    assert markup.repair_cp850(broken) == "canción"
    assert markup.repair_cp850("plain ─ text") == "plain ─ text"


@pytest.mark.parametrize(
    ("raw", "want"),
    [('{"a": 1}', '{"a": 1}'), ('so {"a": "}"} end', '{"a": "}"}'), ("none", None), ("[1]", None), (None, None), ('{"a": {"b": 2}} {"c": 3}', '{"a": {"b": 2}}')],
)
def test_object_in(raw, want):
    assert markup.object_in(raw) == want
