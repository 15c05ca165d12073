"""A paged search as a Python data source: one partition per page of recorded or live responses, as a table or
as a stream whose offsets are the pages' places, so that a stopped search goes on with the page after the last committed."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "paper_id string, title string, year int, abstract string, venue string, url string, pdf string"


class Page(InputPartition):
    def __init__(self, offset: int):
        self.offset = offset


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        limit, most = int(self.options.get("limit", 100)), int(self.options.get("most", 1000))
        return [Page(k) for k in range(0, most, limit)]

    def _fetch(self, offset: int) -> dict:
        if "recorded" in self.options:
            pages = json.loads(self.options["recorded"])
            return pages.get(str(offset), {"data": []})
        query = {"query": self.options["keyword"], "limit": self.options.get("limit", 100), "offset": offset}
        wait = float(self.options.get("wait", 5))
        for k in range(5):
            try:
                with urllib.request.urlopen(self.options["endpoint"] + "?" + urllib.parse.urlencode(query), timeout=30) as f:
                    return json.load(f)
            except OSError as e:
                if getattr(e, "code", None) == 403 or k == 4:
                    raise  # a page that is missing must not pass as an empty one
                time.sleep(wait)
                wait *= 2
        raise AssertionError("unreachable")

    def read(self, partition: Page) -> Iterator[tuple]:
        for p in self._fetch(partition.offset).get("data") or []:
            if p.get("paperId"):
                yield (p["paperId"], p.get("title"), p.get("year"), p.get("abstract"), p.get("venue"), p.get("url"), (p.get("openAccessPdf") or {}).get("url"))


class SearchStreamReader(SearchReader, DataSourceStreamReader):
    """Offsets are places of results (``{"next": n}``), whole pages. The first page tells how many results there are, so the
    latest offset needs no state of this reader: a search that was stopped goes on after the pages of its last committed
    offset, and when results are added, only their pages are read. A range that Spark replays after a failure is the same
    pages again; the sink's log keeps their rows once."""

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        limit, most = int(self.options.get("limit", 100)), int(self.options.get("most", 1000))
        first = self._fetch(0)
        total = first.get("total")
        if total is None:  # a source that does not tell: all pages up to the bound, empty ones at the end
            total = most if first.get("next") is not None else len(first.get("data") or [])
        return {"next": min(most, -(-int(total) // limit) * limit)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Page(k) for k in range(start["next"], end["next"], int(self.options.get("limit", 100)))]

    def commit(self, end: dict) -> None:
        """Nothing is kept for replays: pages can be asked for again."""


class SearchSource(DataSource):
    """spark.dataSource.register(SearchSource); spark.read.format("search").option("keyword", ...).load(), or readStream."""

    @classmethod
    def name(cls) -> str:
        return "search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SearchStreamReader(dict(self.options))
