"""Keyed state with expiry: batches against one pass, timers, rows out of order."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riffle.streaming import state

DAY = datetime(2024, 1, 1)


def _run(spark, tmp_path, batches, ttl, late):
    """Rows let through, and the states left, of a stream of one file for each batch."""
    schema = "user string, ts timestamp, n long"
    source = tmp_path / "in"
    base = f"file://{tmp_path}"
    out = None
    for i, rows in enumerate(batches):
        spark.createDataFrame([(u, DAY + timedelta(hours=h) if h is not None else None, n) for u, h, n in rows], schema).coalesce(1).write.mode("append").parquet(f"file://{source}")
        with state.rocks_state(spark):
            s = spark.readStream.schema(schema).parquet(f"file://{source}").withWatermark("ts", late)
            q = state.first_of_lives(s, ["user"], "ts", "n", ttl).writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out/batch={n}")).option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
            q.awaitTermination()
        out = sorted((r.user or "", int((r.ts - DAY).total_seconds() // 3600), r.n) for r in spark.read.schema(schema).parquet(f"{base}/out/*").collect())
    left = spark.read.format("statestore").option("path", f"{base}/check").option("stateVarName", "alive").load().count()
    return out, left


def test_batches_expire_as_one_pass_does(spark, tmp_path):
    first = [("a", 0, 1), ("a", 1, 2), ("b", 2, 3), ("a", 30, 4), (None, 3, 5), ("c", None, 6)]
    later = [("a", 40, 7), ("b", 60, 8), ("c", 61, 9), ("c", 61, 8)]
    last = [("a", 200, 10)]
    out, left = _run(spark, tmp_path, [first, later, last], timedelta(hours=12), "0 seconds")
    assert out == [("", 3, 5), ("a", 0, 1), ("a", 30, 4), ("a", 200, 10), ("b", 2, 3), ("b", 60, 8), ("c", 61, 8)]
    # The timers of all but the last key have fired.
    assert left == 1


def test_rows_out_of_order_open_nothing(spark, tmp_path):
    out, left = _run(spark, tmp_path, [[("a", 50, 1)], [("a", 45, 2), ("a", 62, 3)], [("a", 80, 4)]], timedelta(hours=12), "10 days")
    assert out == [("a", 50, 1), ("a", 80, 4)] and left == 1


def test_emission_is_a_window_of_its_own(spark):
    rows = spark.createDataFrame([(1, DAY), (2, DAY + timedelta(hours=5))], "n long, ts timestamp")
    assert [r.n for r in state.emitted(rows, "ts", F.lit(DAY + timedelta(hours=6)), timedelta(hours=2)).collect()] == [2]


def test_the_store_is_chosen_for_the_stream_only(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    with pytest.raises(KeyError), state.rocks_state(spark):
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == state.ROCKS
        raise KeyError
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
