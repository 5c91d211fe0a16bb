"""A paged REST collection as a Spark data source.

`spark.dataSource.register(PagedRest)` then
`spark.read.format("paged_rest").options(root=..., resource=...).load()`.
Each page is one input partition, so pages are fetched in parallel. `root` is a
folder of saved responses `<resource>/page-<n>.json` (a list per page) with the
page total in `<resource>/total`; a fetcher for a live service plugs in by
subclassing and overriding `fetch`.
"""

from __future__ import annotations

import hashlib
import json
import os
import random
import time
from urllib.parse import urlencode

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PER_PAGE, RETRIES, RETRY_BASE = 100, 4, 2.0
SKIP_STATUS = (401, 403, 404, 410)


class PagePartition(InputPartition):
    def __init__(self, page: int):
        self.page = page


def cache_key(url: str, params: dict) -> str:
    """Name of a saved response."""
    return hashlib.sha1(f"{url}?{urlencode(sorted(params.items()))}".encode()).hexdigest()


def looks_blocked(body: str) -> bool:
    """A firewall's HTML page in place of JSON."""
    head = body.lstrip()[:200].lower()
    return head.startswith("<!doctype html") or head.startswith("<html")


def with_retry(call, retries: int = RETRIES, base: float = RETRY_BASE, pause=time.sleep):
    """Repeat `call` with exponential waits; the last error is raised."""
    for attempt in range(retries):
        try:
            return call()
        except (OSError, ValueError):
            if attempt == retries - 1:
                raise
            pause(base ** attempt + random.random())


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.resource = options["root"], options["resource"]
        self.per_page = int(options.get("per_page", PER_PAGE))

    def total_pages(self) -> int:
        with open(os.path.join(self.root, self.resource, "total"), encoding="utf-8") as f:
            return int(f.read().strip())

    def fetch(self, page: int) -> str:
        with open(os.path.join(self.root, self.resource, f"page-{page}.json"), encoding="utf-8") as f:
            return f.read()

    def partitions(self):
        return [PagePartition(p) for p in range(1, self.total_pages() + 1)]

    def read(self, partition):
        body = with_retry(lambda: self.fetch(partition.page), pause=lambda s: None)
        if looks_blocked(body):
            raise RuntimeError(f"{self.resource} page {partition.page}: blocked by a firewall page")
        for item in json.loads(body):
            yield (partition.page, int(item.get("id", 0)), json.dumps(item, ensure_ascii=False))


class PagedRest(DataSource):
    """Columns: page, id, body (the item as JSON text)."""

    @classmethod
    def name(cls):
        return "paged_rest"

    def schema(self):
        return "page int, id bigint, body string"

    def reader(self, schema):
        return PagedReader(self.options)
