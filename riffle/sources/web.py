"""A batch source that fetches addresses: spark.read.format("riffle_http").option("urls", ...)."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from email.utils import parsedate_to_datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Seconds to wait on a 429, whatever the server asks for.
LONGEST_WAIT = 60.0


def retry_delay(headers: dict[str, str], default: float = 5.0, now: Callable[[], float] = time.time) -> float:
    """Seconds that a 429 asks to wait, LONGEST_WAIT at most: until its token window is full,
    plus one, else Retry-After, in seconds, which may be 0, or as a date, at least 1."""
    low = {k.lower(): (v or "").strip() for k, v in headers.items()}
    bound = lambda s: min(LONGEST_WAIT, max(1.0, s))
    for key, more in (("x-ratelimit-reset-tokens", 1.0), ("x-ratelimit-reset", 1.0), ("retry-after", 0.0)):
        try:
            seconds = float(low[key])
            return min(LONGEST_WAIT, max(0.0, seconds)) if key == "retry-after" else bound(seconds + more)
        except (KeyError, ValueError):
            continue
    try:
        return bound(parsedate_to_datetime(low["retry-after"]).timestamp() - now())
    except (KeyError, ValueError, TypeError):
        return default


def fetch(url: str, timeout: float, opener: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep) -> tuple[int, bytes]:
    """(status, body), with one more try after a 429; a failed connection has status 0."""
    for turn in (0, 1):
        try:
            with opener(urllib.request.Request(url, headers={"User-Agent": "riffle"}), timeout=timeout) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            if e.code != 429 or turn:
                return e.code, b""
            sleep(retry_delay(dict(e.headers or {})))
        except (urllib.error.URLError, TimeoutError, OSError):
            return 0, b""
    return 0, b""


class HttpSource(DataSource):
    """Rows (url, status, body), a partition for each address."""

    @classmethod
    def name(cls) -> str:
        return "riffle_http"

    def schema(self) -> str:
        return "url string, status int, body binary"

    def reader(self, schema) -> HttpReader:
        return HttpReader(self.options)


class HttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.timeout = float(options.get("timeout", "15"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        status, body = fetch(partition.value, self.timeout)
        yield partition.value, status, body
