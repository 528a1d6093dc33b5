"""Keyed state with expiry: what a stream has seen of each key, in the state store.

A key's state is opened by its first row and kept alive by later ones; it expires `ttl`
after the last. The row that opens it is let through, rows that find it alive are
duplicates. A row that comes more than ttl after the one before opens it anew, whether
the timer that frees the state has fired by then or not, so the result doesn't depend on
how rows fall into batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lives(StatefulProcessor):
    """Lets the rows through that open a key's state; columns: the keys, `at` in microseconds, `row`."""

    def __init__(self, ttl_micros: int, names: list[str]):
        self.ttl, self.names = ttl_micros, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alive = handle.getValueState("alive", "opened long, last long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # Of a key's rows in a batch only two numbers each are held.
        parts = [(f["at"].to_numpy(np.int64), f["row"].to_numpy()) for f in rows]
        at, row = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.lexsort((row, at))
        at, row = at[order], row[order]
        state = self.alive.get() if self.alive.exists() else None
        before = state[1] if state else None
        # The latest instant seen so far, which a row out of order doesn't take back.
        last = np.maximum.accumulate(np.concatenate([[at[0] if before is None else before], at]))
        opens = at - last[:-1] > self.ttl
        opens[0] |= before is None
        opened = int(at[opens][-1]) if opens.any() else state[0]
        if state:
            self.handle.deleteTimer(state[2])
        timer = (int(last[-1]) + self.ttl) // 1_000 + 1
        self.handle.registerTimer(timer)
        self.alive.update((opened, int(last[-1]), timer))
        if opens.any():
            yield pd.DataFrame({**{k: [v] * int(opens.sum()) for k, v in zip(self.names, key)}, "at": at[opens], "row": row[opens]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.alive.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_of_lives(df: DataFrame, keys: list[str], at: str, row: str, ttl: timedelta) -> DataFrame:
    """(keys, at, row) of the rows of a stream that open their key's state; `at` has a
    watermark (rows older than it are dropped), `row` is a number that tells rows of one
    instant apart, the least of which opens. Rows without an instant are dropped; null keys
    are a key. Needs the state store of rocks_state()."""
    micros = int(ttl.total_seconds() * 1_000_000)
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("at", T.LongType()), T.StructField("row", df.schema[row].dataType)])
    marked = df.where(F.col(at).isNotNull()).select(*keys, at, F.unix_micros(at).alias("at"), F.col(row).alias("row"))
    got = marked.groupBy(*keys).transformWithStateInPandas(Lives(micros, keys), schema, "append", "eventTime")
    return got.select(*keys, F.timestamp_micros("at").alias(at), F.col("row").alias(row))


class rocks_state:  # noqa: N801
    """Within it, streams that are started keep their state in RocksDB, which expiry needs."""

    def __init__(self, spark):
        self.conf, self.name = spark.conf, "spark.sql.streaming.stateStore.providerClass"

    def __enter__(self):
        self.old = self.conf.get(self.name, None)
        self.conf.set(self.name, ROCKS)

    def __exit__(self, *error):
        self.conf.unset(self.name) if self.old is None else self.conf.set(self.name, self.old)


def emitted(df: DataFrame, at: str, now, window: timedelta) -> DataFrame:
    """Rows at most `window` older than now; the state behind them lives longer."""
    return df.where(F.unix_micros(at) >= F.unix_micros(now) - int(window.total_seconds() * 1_000_000))
