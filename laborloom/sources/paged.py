"""A Python data source over a paginated service, with a partition for each keyword and page."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "keyword string, page int, external_id string, payload string"


class _Page(InputPartition):
    def __init__(self, keyword: str, page: int) -> None:
        self.keyword, self.page = keyword, page


class RateLimited(Exception):
    """The service asks to slow down, or refuses a key."""


class Throttle:
    """Waits so that there are at most `rate` calls a second."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.clock, self.sleep, self.next = 1.0 / rate if rate > 0 else 0.0, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


def fetch_with_retry(fetch: Callable[..., list[dict]], keyword: str, page: int, tries: int = 3, wait: float = 0.5, keys: list[str] | None = None, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """A page's records; a failure is tried again after a growing wait, the last one is raised.

    With `keys`, fetch gets one as a third argument; where the service refuses it, the next key is tried at once, and only
    when all were refused there is a wait.
    """
    for k in range(tries):
        for key in keys or [None]:
            try:
                return fetch(keyword, page) if key is None else fetch(keyword, page, key)
            except RateLimited as e:
                last: Exception = e
            except OSError as e:
                last = e
                break
        if k == tries - 1:
            raise last
        sleep(wait * 2**k)
    return []


def fetch_all(fetch: Callable[..., list[dict]], keyword: str, most: int, size: int, throttle: Throttle | None = None, **options) -> Iterator[tuple[int, dict]]:
    """(page, record) of a keyword's pages one after another, until one has less than `size` records or `most` were read."""
    for page in range(most):
        if throttle:
            throttle.wait()
        got = fetch_with_retry(fetch, keyword, page, **options)
        yield from ((page, r) for r in got)
        if len(got) < size:
            return


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        keywords = self.options["keywords"].split(",")
        if "size" in self.options:  # a keyword's pages end somewhere, so one task follows them
            return [_Page(k, -1) for k in keywords]
        return [_Page(k, p) for k in keywords for p in range(int(self.options.get("pages", 1)))]

    def read(self, partition: _Page) -> Iterator[tuple]:
        module, name = self.options["fetch"].rsplit(".", 1)
        fetch = getattr(__import__(module, fromlist=[name]), name)
        keys = [k for k in self.options.get("keys", "").split(",") if k] or None
        if partition.page < 0:
            throttle = Throttle(float(self.options["rate"])) if "rate" in self.options else None
            found = fetch_all(fetch, partition.keyword, int(self.options.get("pages", 1_000)), int(self.options["size"]), throttle, keys=keys)
        else:
            found = ((partition.page, r) for r in fetch_with_retry(fetch, partition.keyword, partition.page, keys=keys))
        for page, r in found:
            yield partition.keyword, page, str(r.get("id")), json.dumps(r, sort_keys=True)


class PagedSource(DataSource):
    """Options: keywords (commas between), pages, fetch (dotted name of a function of keyword, page and, with keys, a key), keys
    (commas between), and size, the records of a full page: with it a keyword's pages are read until one is not full, at most `rate`
    a second."""

    @classmethod
    def name(cls) -> str:
        return "paged_postings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def demo_fetch(keyword: str, page: int) -> list[dict]:
    """A stand-in for a service, for tests: two records a page."""
    return [{"id": f"{keyword}-{page}-{i}", "title": f"{keyword} {i}"} for i in range(2 if page < 3 else 1)]
