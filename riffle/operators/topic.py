"""Topic classifier: weighted lexicons over title, address and the body's beginning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.domain import DomainPack
from riffle.functions.text import fold, literal, phrase_pattern

#: Characters of the folded body that count.
BODY = 400


def mask(folded: Column, suppress: tuple[str, ...]) -> Column:
    """Folded text without the suppressed phrases."""
    return F.regexp_replace(folded, phrase_pattern(suppress), " ") if suppress else folded


def padded(folded: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(folded), F.lit(" "))


def hits(text: Column, signals: tuple[str, ...]) -> Column:
    """The distinct signals that occur as whole words in padded text, in the plural too; each
    counts once. One test for each signal, not a filter whose body would fold the text anew."""
    found = [F.when(text.contains(f" {s} ") | text.contains(f" {s}s "), F.lit(s)) for s in signals]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def feed_signals(categories: Column, pack: DomainPack) -> tuple[Column, Column]:
    """(hard negative category present, boost of 0 or 1)."""
    folded = F.coalesce(F.transform(categories, lambda c: F.trim(fold(c))), F.array().cast("array<string>"))
    has = lambda words: F.arrays_overlap(folded, literal(words)) if words else F.lit(False)
    boost = F.when(has(pack.feed_positive) & ~has(pack.feed_soft_negative), 1).otherwise(0)
    return F.coalesce(has(pack.feed_hard_negative), F.lit(False)), F.coalesce(boost, F.lit(0))


def classify(df: DataFrame, pack: DomainPack, anchor_name: Column | None = None) -> DataFrame:
    """df with topic_pos, topic_neg, topic_ok and topic_reason.

    pos = 2 strong + weak signals (title, address, body) + 2 for a known title in the title
    + 2 for a rescued name + the feed's boost; neg = 2 strong + weak negative signals of
    title and address. With neg > 0 pos must exceed it by 2, else pos must reach 2.
    anchor_name: the name found before an anchor word, or null.
    """
    title, url = mask(fold(F.coalesce("title", F.lit(""))), pack.suppress), fold(F.coalesce("url", F.lit("")))
    body = F.substring(mask(fold(F.coalesce("body_text", F.lit(""))), pack.suppress), 1, BODY)
    texts = F.struct(title.alias("title"), url.alias("url"), body.alias("body"))
    # Each text is folded once: the next step takes it from here by name, several times.
    df = df.withColumn("_f", texts)
    f = F.col("_f")
    df = df.withColumn("_p", F.struct(padded(f["title"]).alias("title"), padded(F.concat_ws(" ", f["title"], f["url"])).alias("head"), padded(F.concat_ws(" ", f["title"], f["url"], f["body"])).alias("whole")))
    title, head, whole = (F.col("_p")[c] for c in ("title", "head", "whole"))
    hard, boost = feed_signals(F.col("feed_categories"), pack)
    sp, wp = hits(whole, pack.strong_positive), hits(whole, pack.weak_positive)
    sn, wn = hits(head, pack.strong_negative), hits(head, pack.weak_negative)
    known = F.size(hits(title, tuple(pack.known_titles))) > 0
    show = F.lit(False)
    for word in pack.entertainment:
        show |= head.contains(word)
    rescue = anchor_name.isNotNull() & (F.size(sn) == 0) & ~show if anchor_name is not None else F.lit(False)
    staged = df.withColumn(
        "_t", F.struct(sp.alias("sp"), wp.alias("wp"), sn.alias("sn"), wn.alias("wn"), known.alias("known"), rescue.alias("rescue"), hard.alias("hard"), boost.alias("boost"))
    )
    t = F.col("_t")
    flag = lambda c: F.when(c, 2).otherwise(0)
    pos = 2 * F.size(t["sp"]) + F.size(t["wp"]) + flag(t["known"]) + flag(t["rescue"]) + t["boost"]
    neg = 2 * F.size(t["sn"]) + F.size(t["wn"])
    p, n = F.col("topic_pos"), F.col("topic_neg")
    ok = ~t["hard"] & F.when(n > 0, p - n >= 2).otherwise(p >= 2)
    first = F.array_min(F.concat(t["sn"], t["wn"]))
    reason = (
        F.when(t["hard"], F.lit("feed_section"))
        .when((n > 0) & (p - n >= 2), F.lit("positive_over_negative"))
        .when(n > 0, F.concat(F.lit("negative:"), first))
        .when(p < 2, F.lit("too_little"))
        .when(F.size(t["sp"]) > 0, F.lit("strong_positive"))
        .when(t["known"], F.lit("known_title"))
        .when(t["rescue"], F.lit("name_found"))
        .when(t["boost"] > 0, F.lit("feed_context"))
        .otherwise(F.lit("several_weak"))
    )
    return staged.withColumns({"topic_pos": pos, "topic_neg": neg}).withColumns({"topic_ok": ok, "topic_reason": reason}).drop("_t", "_f", "_p")


def on_topic(df: DataFrame, pack: DomainPack, anchor_name: Column | None = None) -> DataFrame:
    """Rows on topic; only media rows are asked, stores and reddit pass."""
    media = df.where("source_type = 'media'")
    kept = classify(media, pack, anchor_name).where("topic_ok").select(df.columns)
    return kept.unionByName(df.where("source_type <> 'media'"))
