"""Schemas of items and digests, row validity, and the split into valid rows and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riffle.functions.text import strip

# Stored documents hold these words.
SOURCE_TYPES = ("media", "steam", "reddit")
LANGUAGES = ("es", "en")
CATEGORIES = ("lanzamiento", "actualizacion", "rumor", "analisis")
ORIGINS = ("matcher", "ai", "generico")

_S, _L, _I, _TS, _B = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType(), T.BooleanType()
ITEMS_RAW = T.StructType(
    [T.StructField("pos", _L)]
    + [T.StructField(c, _S) for c in ("title", "url", "source", "source_type", "source_subreddit")]
    + [T.StructField(c, _TS) for c in ("published_at", "fetched_at")]
    + [T.StructField(c, _S) for c in ("body_text", "language", "game", "image_url", "author", "game_id")]
    + [T.StructField("feed_categories", T.ArrayType(_S))]
)
ITEMS = T.StructType(
    [T.StructField(c, _S) for c in ("id", "title", "summary", "url", "source", "source_type", "source_subreddit", "game", "game_id", "game_origin", "language")]
    + [T.StructField(c, _TS) for c in ("published_at", "fetched_at")]
    + [T.StructField("relevance", _I), T.StructField("category", _S), T.StructField("image", _S), T.StructField("author", _S)]
    + [T.StructField("is_verified", _B), T.StructField("summary_is_fallback", _B)]
)
#: As items stand in a digest document: instants as ISO text, no fallback flag.
DIGEST_ITEM = T.StructType(
    [T.StructField(f.name, _S if f.dataType == _TS else f.dataType) for f in ITEMS.fields if f.name != "summary_is_fallback"]
)
DIGEST = T.StructType([T.StructField("generated_at", _S), T.StructField("total", _L), T.StructField("news", T.ArrayType(DIGEST_ITEM))])


def optional_text(c: Column) -> Column:
    """Trimmed; empty becomes null."""
    return F.nullif(strip(c), F.lit(""))


def is_http(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)^https?://"), F.lit(False))


def clean_image(c: Column) -> Column:
    """Trimmed image address; null unless http(s)."""
    return F.when(is_http(F.trim(c)), F.trim(c))


def in_enum(c: Column, values: tuple[str, ...]) -> Column:
    """Trimmed exact membership; null is no member."""
    return F.coalesce(F.trim(c).isin(*values), F.lit(False))


def is_generic(c: Column, generic: tuple[str, ...]) -> Column:
    """Null, or a generic entity name after trimming, whatever its case."""
    return F.coalesce(F.lower(F.trim(c)).isin(*[g.lower() for g in generic]), F.lit(True))


def bad_source(source: Column, kind: Column, subreddit: Column) -> Column:
    """Reason why a source is invalid: a subreddit is there if and only if the type is reddit."""
    has = optional_text(subreddit).isNotNull()
    return (
        F.when(optional_text(source).isNull(), "source_empty")
        .when(~in_enum(kind, SOURCE_TYPES), "source_type_unknown")
        .when((F.trim(kind) == "reddit") & ~has, "subreddit_missing")
        .when((F.trim(kind) != "reddit") & has, "subreddit_unexpected")
    )


def raw_reject_reason(c=F.col) -> Column:
    """First rule that a raw item breaks, or null."""
    return F.coalesce(
        F.when(optional_text(c("title")).isNull(), "title_empty").when(~is_http(F.trim(c("url"))), "url_not_http"),
        bad_source(c("source"), c("source_type"), c("source_subreddit")),
        F.when(c("published_at").isNull(), "published_at_missing")
        .when(c("fetched_at").isNull(), "fetched_at_missing")
        .when(c("language").isNotNull() & ~in_enum(c("language"), LANGUAGES), "language_unknown"),
    )


def item_reject_reason(stable_id: Column, c=F.col) -> Column:
    """First rule that an enriched item breaks, or null; stable_id is the id that its address gives."""
    return F.coalesce(
        F.when(optional_text(c("title")).isNull(), "title_empty").when(~is_http(F.trim(c("url"))), "url_not_http"),
        bad_source(c("source"), c("source_type"), c("source_subreddit")),
        F.when(optional_text(c("game")).isNull(), "game_empty")
        .when(~in_enum(c("game_origin"), ORIGINS), "game_origin_unknown")
        .when(~in_enum(c("language"), LANGUAGES), "language_unknown")
        .when(c("published_at").isNull(), "published_at_missing")
        .when(c("fetched_at").isNull(), "fetched_at_missing")
        .when(~F.coalesce(c("relevance").between(1, 5), F.lit(False)), "relevance_out_of_range")
        .when(~in_enum(c("category"), CATEGORIES), "category_unknown")
        .when(c("is_verified").isNull(), "is_verified_missing")
        .when(c("summary").isNull() != F.coalesce(c("summary_is_fallback"), F.lit(False)), "summary_flag_mismatch")
        .when(c("id").isNotNull() & (c("id") != stable_id), "id_mismatch"),
    )


def split_valid(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects with reject_reason): one pass each, no row lost."""
    marked = df.withColumn("reject_reason", reason)
    return marked.where("reject_reason is null").drop("reject_reason"), marked.where("reject_reason is not null")


def routed(df: DataFrame, reason: Column, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects with reject_reason), both read from a table at path that one pass
    over df has written, partitioned by reason."""
    df.withColumn("reject_reason", reason).write.partitionBy("reject_reason").parquet(path)
    whole = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("reject_reason", _S)])).parquet(path)
    return whole.where("reject_reason is null").drop("reject_reason"), whole.where("reject_reason is not null")


def to_iso(ts: Column) -> Column:
    """ISO text in UTC; microseconds only where they aren't zero."""
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    )


def from_iso(text: Column) -> Column:
    """Instant of ISO text with a zone; null if it has none or can't be read."""
    return F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(text))
