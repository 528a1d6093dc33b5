"""A feed landed as a folder of many files."""

from __future__ import annotations

from pyspark.sql import functions as F

from riffle.sources import feeds


def test_files_go_by_the_numbers_in_their_names(spark, tmp_path):
    """Spark names a task's files c000 to c999, then c1000; the rows of a feed are in that order."""
    numbers = [7, 98, 99, 100, 998, 999, 1000, 1001, 10_000]
    for n in numbers:
        items = "".join(f"<item><title>{n} {i}</title><link>https://e.org/{n}/{i}</link></item>" for i in range(12))
        (tmp_path / f"part-00000-1a-c{n:03}.txt").write_text(f"<rss><channel>{items}</channel></rss>")
    got = feeds.read_feed(spark, feeds.Landed(str(tmp_path), "Daily", "media", "en"), F.timestamp_seconds(F.lit(1_706_572_800)))
    want = [f"{n} {i}" for n in numbers for i in range(12)]
    assert {r.pos: r.title for r in got.collect()} == dict(enumerate(want))
    few = feeds.read_feed(spark, feeds.Landed(str(tmp_path), "Daily", "media", "en", limit=80), F.timestamp_seconds(F.lit(1_706_572_800)))
    assert {r.pos: r.title for r in few.collect()} == dict(enumerate(want[:80]))
