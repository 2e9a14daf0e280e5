"""Pages fetched over HTTP, as a data source: on the executors, with retries."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Paths with their volatility, and limits of a fetch.
PAGES = [("/", False), ("/terms", False), ("/result", True)]
ATTEMPTS, TIMEOUT = 3, 20.0
# End of fixed values.


def get(url: str, timeout: float = TIMEOUT) -> str:
    """The body of a page, redirects followed; raises for any status but success."""
    with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310  the caller's own addresses
        return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")


def persistent(fetch: Callable[[str], str], attempts: int = ATTEMPTS, pause: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """fetch, tried again after 1, 2, 4, ... seconds; a page that stays away ends the job, as half a corpus is none."""

    def run(url: str) -> str:
        for n in range(attempts):
            try:
                return fetch(url)
            except Exception as error:  # noqa: BLE001  any failure of transport or status is tried again
                if n + 1 == attempts:
                    raise RuntimeError(f"could not fetch {url}: {error}") from error
                pause(2.0**n)
        raise ValueError("at least one attempt is needed")

    return run


@dataclass
class Page(InputPartition):
    """One page to fetch: a partition of its own, so pages are fetched side by side and each is tried again by itself."""

    page_id: int
    url: str
    volatile: bool


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.base = options["base"].rstrip("/")
        self.attempts, self.timeout = int(options.get("attempts", ATTEMPTS)), float(options.get("timeout", TIMEOUT))
        self.volatile = str(options.get("volatile", "false")).lower() == "true"
        self.listed = [tuple(x) for x in json.loads(options["pages"])] if "pages" in options else PAGES

    def partitions(self) -> list[Page]:
        return [Page(n, f"{self.base}{path}", changes) for n, (path, changes) in enumerate(self.listed) if self.volatile or not changes]

    def read(self, partition: Page) -> Iterator[tuple]:
        html = persistent(lambda url: get(url, self.timeout), self.attempts)(partition.url)
        yield partition.page_id, partition.url, html, partition.volatile


class PageSource(DataSource):
    """Format "pages": page_id, url, html and volatile of a site's pages, fetched when they are read.

    Options: base; volatile, to read those pages too; pages, a JSON list of [path, volatile]; attempts; timeout in seconds.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "page_id long, url string, html string, volatile boolean"

    def reader(self, schema) -> PageReader:
        if "base" not in self.options:
            raise ValueError("option base is missing")
        return PageReader(dict(self.options))


def fetch_pages(spark: SparkSession, base: str, pages: list[tuple[str, bool]] = PAGES, volatile: bool = False) -> DataFrame:
    """page_id, url, html and volatile of each page; volatile ones only if asked for."""
    spark.dataSource.register(PageSource)
    return spark.read.format("pages").options(base=base, volatile=volatile, pages=json.dumps(pages)).load()
