"""Pull requests from a paged REST source, as a Spark data source in Python.

One partition reads a range of pages of one repository, so pages are fetched by the
executors, each range on its own and again from its start if it is lost. A request that is
refused for its rate or fails on the other side is tried again after 4, 8, 16, ... seconds,
a bounded number of times; then the task fails. As a stream, the source's offset is the
number of full pages of each repository: with pulls in the order of their creation a full
page does not change any more, so each row comes once.

    spark.dataSource.register(PagedPulls)
    spark.read.format("paged_pulls").options(address="https://api.example", repos="a/b,c/d").load()
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "repo string, page int, tries int, number long, url string, title string, body string, merged_at string, diff_url string"
#: Answers after which a request is worth another try.
TRANSIENT = (403, 408, 429, 500, 502, 503, 504)


@dataclass(frozen=True)
class PagedOptions:
    #: The service's address, or a folder of recorded pages (``<owner>__<name>/<page>.json``) that all executors can open.
    address: str
    repos: tuple[str, ...]
    per_page: int = 100
    most_pages: int = 100
    pages_per_task: int = 10
    tries: int = 5
    #: Seconds before the second try; each further one waits twice as long.
    pause: float = 4.0
    #: Seconds between two pages of a task.
    pace: float = 0.0

    @classmethod
    def of(cls, options: dict[str, str]) -> PagedOptions:
        given = {k.lower(): v for k, v in options.items()}
        if "address" not in given or not given.get("repos"):
            raise ValueError("address and repos are needed")
        kinds = {"per_page": int, "most_pages": int, "pages_per_task": int, "tries": int, "pause": float, "pace": float}
        return cls(given["address"], tuple(r.strip() for r in given["repos"].split(",") if r.strip()), **{k: kind(given[k]) for k, kind in kinds.items() if k in given})


def fetch(options: PagedOptions, repo: str, page: int, attempt: int) -> tuple[int, str]:
    """Status and text of one request; recorded pages may have a list of the statuses of the first tries beside them."""
    if "://" in options.address and not options.address.startswith("file:"):
        url = f"{options.address}/repos/{repo}/pulls?state=closed&sort=created&direction=asc&per_page={options.per_page}&page={page}"
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json"}), timeout=60) as answer:
                return answer.status, answer.read().decode("utf-8")
        except urllib.error.HTTPError as e:
            return e.code, ""
        except (urllib.error.URLError, TimeoutError):
            return 503, ""
    at = Path(options.address.removeprefix("file://")) / repo.replace("/", "__")
    statuses = at / f"{page}.statuses"
    planned = json.loads(statuses.read_text()) if statuses.exists() else []
    if attempt <= len(planned) and planned[attempt - 1] != 200:
        return planned[attempt - 1], ""
    recorded = at / f"{page}.json"
    return 200, recorded.read_text(encoding="utf-8") if recorded.exists() else "[]"


def pulls(options: PagedOptions, repo: str, page: int) -> tuple[list[dict], int]:
    """The pulls of one page, and how many tries it took."""
    for attempt in range(1, options.tries + 1):
        status, text = fetch(options, repo, page, attempt)
        if status == 200:
            return json.loads(text), attempt
        if status not in TRANSIENT:
            break
        if attempt < options.tries:
            time.sleep(options.pause * 2 ** (attempt - 1))
    raise ConnectionError(f"{repo}, page {page}: status {status} after {attempt} tries")


@dataclass
class PageRange(InputPartition):
    repo: str
    first: int
    last: int


def _read(options: PagedOptions, part: PageRange) -> Iterator[tuple]:
    for page in range(part.first, part.last + 1):
        if options.pace and page > part.first:
            time.sleep(options.pace)
        found, tries = pulls(options, part.repo, page)
        for p in found:
            yield part.repo, page, tries, p.get("number"), p.get("html_url"), p.get("title"), p.get("body"), p.get("merged_at"), p.get("diff_url")
        if len(found) < options.per_page:
            break  # the last page of the repository


class _Reader(DataSourceReader):
    def __init__(self, options: PagedOptions) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        o = self.options
        return [PageRange(repo, first, min(first + o.pages_per_task - 1, o.most_pages)) for repo in o.repos for first in range(1, o.most_pages + 1, o.pages_per_task)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        return _read(self.options, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: PagedOptions) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.options.repos, 0)

    def _full(self, repo: str, page: int) -> bool:
        return page <= self.options.most_pages and len(pulls(self.options, repo, page)[0]) >= self.options.per_page

    def latestOffset(self) -> dict:
        """The number of full pages, by doubling and halving: a logarithmic number of requests."""
        out = {}
        for repo in self.options.repos:
            low, high = 0, 1
            while self._full(repo, high):
                low, high = high, high * 2
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if self._full(repo, middle) else (low, middle)
            out[repo] = low
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        step = self.options.pages_per_task
        return [PageRange(repo, first, min(first + step - 1, end[repo])) for repo in end for first in range(start.get(repo, 0) + 1, end[repo] + 1, step)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        return _read(self.options, partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept here: pages stay at the source."""


class PagedPulls(DataSource):
    """(repo, page, tries, number, url, title, body, merged_at, diff_url); options as in ``PagedOptions``."""

    @classmethod
    def name(cls) -> str:
        return "paged_pulls"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(PagedOptions.of(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(PagedOptions.of(self.options))
