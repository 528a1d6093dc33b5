"""The rolling state: digest documents, migration of old rows, upsert, retention and publication.

The history is dealt by id into buckets, each a folder of files. A run rewrites the buckets
that its rows fall into, writes its published rows, its document and its rejects into a
new version folder, and then puts down one pointer file that names all of them, with the
untouched buckets where they were: readers follow the last pointer, so the set changes at
once, and a lost run leaves nothing seen. What retention drops from buckets that weren't
rewritten is left out when they are read.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from riffle.functions.markup import fix_mojibake
from riffle.functions.text import fix_interpunct, subreddit_of
from riffle.functions.urls import stable_id
from riffle.schema import DIGEST_ITEM, ITEMS, clean_image, from_iso, item_reject_reason, optional_text, split_valid, to_iso

from .joins import upsert
from .ordered import numbered
from .tables import written
from .topk import newest_first, retain

_FIELDS = [f.name for f in DIGEST_ITEM.fields]
#: Rows of which the last is found by keeping them all in a task; a larger number is counted off by ranges.
_SORTED_MOST = 50_000
_HEAD, _FOOT = '{"generated_at":"', "]}"


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """(pos, raw variant) of the rows of a digest document; none if it is missing or no such
    document. A document of this library is read line by line, whatever its size; any other
    is one JSON text."""
    empty = spark.createDataFrame([], "pos int, raw string").select("pos", F.try_parse_json("raw").alias("raw"))
    try:
        lines = spark.read.text(path).select("value", "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
        own = not lines.where(F.col("value").startswith(_HEAD) & F.col("value").endswith('"news":[')).isEmpty()
    except AnalysisException:
        return empty
    if own:
        rows = lines.where(F.col("value").rlike("^,?\\{") & ~F.col("value").startswith(_HEAD))
        placed = numbered(rows, [F.col("file_name"), F.col("file_block_start"), F.col("line")])
        return placed.select(F.col("n").cast("int").alias("pos"), F.try_parse_json(F.ltrim("value", F.lit(","))).alias("raw"))
    news = F.try_variant_get(F.try_parse_json("value"), "$.news", "array<variant>")
    return spark.read.text(path, wholetext=True).select(F.posexplode(news).alias("pos", "raw"))


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("raw", f"$.{path}", kind)


def migrate(rows: DataFrame) -> DataFrame:
    """Rows (pos, raw) of any age as items: a nested source is flattened, repaired text is
    repaired, a missing subreddit is taken from the source's name, fetched_at from
    published_at, image from image_url, is_verified from the source's type and game_origin
    from the time when there was one only. Values of a wrong type become null."""
    nested = F.coalesce(F.schema_of_variant(F.try_variant_get("raw", "$.source", "variant")).startswith("OBJECT"), F.lit(False))
    is_text = lambda p: F.schema_of_variant(F.try_variant_get("raw", f"$.{p}", "variant")) == "STRING"
    text = lambda p: F.when(is_text(p), _get(p))
    has = lambda p: F.try_variant_get("raw", f"$.{p}", "variant").isNotNull()
    kind = F.when(nested, F.coalesce(_get("source.type"), F.lit("media"))).otherwise(text("source_type"))
    flat = rows.select(
        "pos", text("id").alias("id"), fix_mojibake(text("title")).alias("title"), fix_mojibake(text("summary")).alias("summary"), text("url").alias("url"),
        fix_mojibake(fix_interpunct(F.when(nested, _get("source.name")).otherwise(text("source")))).alias("source"), kind.alias("source_type"),
        F.when(nested & (kind == "reddit"), _get("source.subreddit")).otherwise(text("source_subreddit")).alias("_sub"),
        text("game").alias("game"), text("game_id").alias("game_id"), F.coalesce(text("game_origin"), F.lit("matcher")).alias("game_origin"), text("language").alias("language"),
        from_iso(text("published_at")).alias("published_at"), from_iso(F.coalesce(optional_text(text("fetched_at")), text("published_at"))).alias("fetched_at"),
        F.when(F.schema_of_variant(F.try_variant_get("raw", "$.relevance", "variant")) == "BIGINT", _get("relevance", "int")).alias("relevance"), text("category").alias("category"),
        clean_image(F.when(has("image"), text("image")).otherwise(text("image_url"))).alias("image"), text("author").alias("author"),
        F.coalesce(_get("is_verified", "boolean"), F.coalesce(kind.isin("media", "steam"), F.lit(False))).alias("is_verified"),
    )
    sub = F.when(F.col("source_type") == "reddit", F.coalesce(optional_text(F.col("_sub")), subreddit_of(F.col("source")))).otherwise(optional_text(F.col("_sub")))
    return flat.withColumns({"source_subreddit": sub, "summary_is_fallback": F.col("summary").isNull()}).select("pos", *ITEMS.fieldNames())


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid items, rejects with reject_reason) of a digest document."""
    return split_valid(migrate(read_document(spark, path)), item_reject_reason(stable_id(F.col("url"))))


def as_digest_item(c=F.col) -> Column:
    """An item as it stands in a document: fields in order, instants as text, no subreddit unless set."""
    return F.struct(*[(to_iso(c(f)) if f in ("published_at", "fetched_at") else c(f)).alias(f) for f in _FIELDS])


def item_json() -> Column:
    """JSON of an item: nulls are written, a null subreddit is left out."""
    whole = F.to_json(as_digest_item(), {"ignoreNullFields": "false"})
    return F.replace(whole, F.lit('"source_subreddit":null,'), F.lit(""))


def document(items: DataFrame, generated_at: Column) -> DataFrame:
    """(n, value): the lines of the JSON document of the items, newest first. Its head and foot
    go with the first and the last item, so that no line waits for another."""
    placed = numbered(items, [F.desc("published_at"), F.asc("pos")], first=1)
    total = items.count()
    head = F.concat(F.lit(_HEAD), to_iso(generated_at), F.lit(f'","total":{total},"news":['))
    if not total:
        return items.sparkSession.range(2).select(F.col("id").alias("n"), F.when(F.col("id") == 0, head).otherwise(F.lit(_FOOT)).alias("value"))
    n = F.col("n")
    row = F.concat(F.when(n > 1, ",").otherwise(""), item_json())
    lines = F.array_compact(F.array(F.when(n == 1, head), row, F.when(n == total, F.lit(_FOOT))))
    return placed.select(F.posexplode(lines).alias("k", "value"), n).select((n * 4 + F.col("k")).alias("n"), "value")


def write_document(items: DataFrame, generated_at: Column, path: str) -> None:
    """The document as a folder of text files: in the order of their names, one after the other,
    they are the document. Each task writes its own range."""
    document(items, generated_at).repartitionByRange("n").sortWithinPartitions("n").select("value").write.text(path)


class Conflict(RuntimeError):
    """Another run stored its version at the same time; this one must be saved again, on top of it."""


class _Files:
    """What the store needs of a file system that Spark writes: a file that comes into being
    once, whole; names in a folder; removal."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def put_new(self, path: str, text: str) -> bool:
        """Whether path is new and holds text now; no two callers are both told so. The text is
        written beside its place; a link (on a local disk) or a rename, which fail where the
        place is taken, puts it there."""
        place, fs = self._at(path)
        beside = self.jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}")
        out = fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getUri().getScheme() != "file":
                return bool(fs.rename(beside, place))
            os.link(beside.toUri().getPath(), place.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            if fs.exists(beside):
                fs.delete(beside, False)

    def names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def remove(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)


def _instant_micros(spark: SparkSession, now: Column) -> int:
    return spark.range(1).select(F.unix_micros(now)).first()[0]


class Store:
    """State under a base folder of any file system that Spark writes and that renames at once.

    buckets: into how many the history is dealt, fixed by the first run; keep: how many
    versions stay readable."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = 64, keep: int = 3):
        self.spark, self.base, self.buckets, self.keep = spark, base.rstrip("/"), buckets, keep
        self.files = _Files(spark)

    def _entry(self, seq: int | None = None) -> dict | None:
        names = [n for n in self.files.names(f"{self.base}/pointer") if n[0].isdigit()]
        if seq is not None:
            names = [n for n in names if int(n) == seq]
        return json.loads(self.spark.read.text(f"{self.base}/pointer/{names[-1]}", wholetext=True).first()["value"]) if names else None

    def _last(self) -> dict | None:
        return self._entry()

    def _rows(self, entry: dict, buckets: list[int] | None = None) -> DataFrame | None:
        """Live rows of the history, or of some buckets."""
        paths = [p for b, p in sorted(entry["buckets"].items()) if buckets is None or int(b) in buckets]
        if not paths:
            return None
        rows = self.spark.read.parquet(*paths)
        at = F.coalesce(F.unix_micros("published_at"), F.lit(-(1 << 62)))
        for seq, floor in entry["floors"]:
            rows = rows.where((F.col("_seq") > seq) | (at >= floor))
        for seq, *cut in entry["cuts"]:
            rows = rows.where((F.col("_seq") > seq) | (F.col("source_type") == "reddit") | (_place(at) > _cut_at(*cut)))
        return rows

    def history(self, seq: int | None = None) -> DataFrame | None:
        """The merged rows of the last version, or of one that is still kept."""
        entry = self._entry(seq)
        rows = self._rows(entry) if entry else None
        return None if rows is None else rows.drop("_seq")

    def _table(self, name: str) -> DataFrame | None:
        entry = self._last()
        return self.spark.read.parquet(entry[name]) if entry and entry[name] else None

    def published(self) -> DataFrame | None:
        return self._table("published")

    def rejects(self) -> DataFrame | None:
        """Rows that the last run set apart, with reject_reason, by which they are partitioned."""
        entry = self._last()
        if not entry or not entry["rejects"]:
            return None
        # Without rows there are no files that would tell the columns.
        return self.spark.read.schema(T.StructType.fromJson(entry["columns"])).parquet(entry["rejects"])

    def _point(self, base: dict | None, entry: dict) -> None:
        """Name entry as the version after base. Where another run has come between, or takes the
        same number at the same time, one of them is named and all others raise Conflict."""
        if (self._last() or {}).get("seq") != (base or {}).get("seq"):
            raise Conflict(self.base)
        if not self.files.put_new(f"{self.base}/pointer/{entry['seq']:012d}", json.dumps(entry)):
            raise Conflict(self.base)

    def save(
        self, new: DataFrame, now: Column, window_hours: float = 24, published_most: int = 200, history_hours: float = 30 * 24, history_most: int = 2000,
        publish_cap: int | None = None, seed: DataFrame | None = None, rejects: DataFrame | None = None,
    ) -> DataFrame:
        """Merge new items (pos and the columns of ITEMS) into the history and publish.

        Without a history `seed`, such as a document's valid rows, stands in. Each branch
        has its own retention; publish_cap bounds the published rows per game. rejects (with
        reject_reason) are kept with the version. Returns the published rows. Saving the same
        rows again changes nothing but the version. A run that stored between this one's
        reading and its end makes it raise Conflict.
        """
        base = self._last()
        seq, count = (base["seq"] + 1, base["count"]) if base else (0, self.buckets)
        version = f"{self.base}/versions/{seq:012d}-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias("_bucket")
        fresh = new
        if seed is not None and not base:
            given = seed.withColumns({"pos": F.col("pos").cast("long"), "id": F.coalesce("id", stable_id(F.col("url")))})
            fresh = upsert(given.select(new.columns), new)
        fresh = written(fresh.select("*", bucket), "store-new")
        touched = [r[0] for r in fresh.select("_bucket").distinct().collect()]
        old = self._rows(base, touched) if base else None
        rows = fresh.drop("_bucket")
        merged = rows if old is None else upsert(old.select(rows.columns), rows)
        merged.select("*", F.lit(seq).alias("_seq"), bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{version}/state")
        entry = {
            "seq": seq, "count": count, "buckets": (base["buckets"] if base else {}) | {str(b): f"{version}/state/_bucket={b}" for b in touched},
            "floors": base["floors"] if base else [], "cuts": base["cuts"] if base else [], "published": f"{version}/published", "document": f"{version}/document", "rejects": None,
        }
        # A floor or cut holds for the rows of its version and of those before: it replaces lower ones.
        floor = _instant_micros(self.spark, now) - int(history_hours * 3_600_000_000)
        entry["floors"] = [f for f in entry["floors"] if f[1] > floor] + [[seq, floor]]
        live = self._rows(entry)
        if live is not None:
            cut = self._cut(live, history_most)
            if cut:
                entry["cuts"] = [c for c in entry["cuts"] if c[1:] > cut] + [[seq, *cut]]
                live = self._rows(entry)
        live = new.limit(0) if live is None else live.select(new.columns)
        retain(live, now, window_hours, published_most, publish_cap, publish_cap).write.parquet(f"{version}/published")
        published = self.spark.read.parquet(f"{version}/published")
        write_document(published, now, f"{version}/document")
        if rejects is not None:
            entry["rejects"], entry["columns"] = f"{version}/rejects", rejects.schema.jsonValue()
            rejects.write.partitionBy("reject_reason").parquet(entry["rejects"])
        self._point(base, entry)
        self._vacuum()
        return newest_first(published)

    def _cut(self, live: DataFrame, most: int) -> list | None:
        """Place of the newest row of media and stores beyond the `most` newest, or None."""
        at = F.coalesce(F.unix_micros("published_at"), F.lit(-(1 << 62)))
        places = live.where("source_type <> 'reddit'").select(_place(at).alias("p"))
        if places.count() <= most:
            return None
        if most > _SORTED_MOST:
            return list(numbered(places, [F.desc("p")]).where(F.col("n") == most).first()["p"])
        return list(places.orderBy(F.desc("p")).limit(most + 1).agg(F.min("p").alias("p")).first()["p"])

    def _vacuum(self) -> None:
        """Remove pointers beyond the versions kept, and version folders that no pointer left names."""
        names = [n for n in self.files.names(f"{self.base}/pointer") if n[0].isdigit()]
        for name in names[: -self.keep]:
            self.files.remove(f"{self.base}/pointer/{name}")
        used = {p[len(self.base) + 10 :].split("/")[0] for n in names[-self.keep :] for e in [self._entry(int(n))] for p in (*e["buckets"].values(), e["published"])}
        newest = int(names[-1])
        for folder in self.files.names(f"{self.base}/versions"):
            # Those of later numbers belong to runs under way.
            if folder not in used and int(folder.split("-")[0]) < newest:
                self.files.remove(f"{self.base}/versions/{folder}")


def _place(at: Column) -> Column:
    """Newer rows have greater places; of one instant those of the lesser pos."""
    return F.struct(at.alias("at"), (-F.col("pos").cast("long")).alias("pos"), F.col("id").alias("id"))


def _cut_at(at: int, pos: int, id: str) -> Column:
    return F.struct(F.lit(at).cast("long").alias("at"), F.lit(pos).cast("long").alias("pos"), F.lit(id).alias("id"))


def read_logos(spark: SparkSession, path: str) -> DataFrame:
    """(name, logo) of the games' file; none if it is missing."""
    schema = "name string, logo string"
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def games_dimension(rules) -> list[dict]:
    """The games' configuration as rows: platform only where there is one."""
    return [{"name": r.name, "aliases": list(r.aliases), "logo": r.logo} | ({"platform": list(r.platform)} if r.platform else {}) for r in rules.include]


def write_games(spark: SparkSession, rules, path: str) -> None:
    rows = [(r.name, list(r.aliases), r.logo, list(r.platform) or None) for r in rules.include]
    spark.createDataFrame(rows, "name string, aliases array<string>, logo string, platform array<string>").coalesce(1).write.mode("overwrite").json(path)
