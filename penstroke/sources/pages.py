"""Pages of a paged service as a data source: one partition a page, each kept in a folder as it arrives, so a run that broke goes on where it was.

    spark.dataSource.register(PagedSource)
    spark.read.format("pages").option("url", "https://host/search?page={page}").option("cache", folder).load()

The answer to page 0 says how many pages there are; reading stops there, or at `maxPages`. The cache is a folder that driver and
executors share (on one machine, any folder). A page is written under another name first and then renamed: what is in the cache is
whole. Options: url (with {page}), cache, maxPages (50), delayMs (400, before each request), attempts (3), pagesField (nbPages)."""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.request
import uuid
from collections.abc import Iterator, Sequence
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class PagePartition(InputPartition):
    def __init__(self, page: int) -> None:
        super().__init__(page)
        self.page = page


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.cache = options["url"], options["cache"]
        if "{page}" not in self.url:
            raise ValueError("url needs {page} in the place of a page's number")
        self.most, self.delay = int(options.get("maxpages", "50")), int(options.get("delayms", "400")) / 1000
        self.attempts, self.field = int(options.get("attempts", "3")), options.get("pagesfield", "nbPages")

    def path(self, page: int) -> Path:
        """Where a page is kept: its name depends on its address, so services can share a cache."""
        return Path(self.cache) / f"{hashlib.sha256(self.url.encode()).hexdigest()[:16]}-{page:06}.json"

    def fetched(self, page: int) -> str:
        """The page from the cache, else from the service, a few times if need be."""
        path = self.path(page)
        if path.exists():
            return path.read_text(encoding="utf-8")
        for attempt in range(1, self.attempts + 1):
            time.sleep(self.delay * attempt)
            try:
                with urllib.request.urlopen(self.url.replace("{page}", str(page)), timeout=60) as answer:
                    text = answer.read().decode("utf-8")
                json.loads(text)  # a page that was cut off is no page
                break
            except (OSError, ValueError):
                if attempt == self.attempts:
                    raise
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_suffix(f".{uuid.uuid4().hex}.part")
        part.write_text(text, encoding="utf-8")
        os.replace(part, path)
        return text

    def partitions(self) -> Sequence[InputPartition]:
        found = json.loads(self.fetched(0))
        pages = found.get(self.field, 1) if isinstance(found, dict) else 1
        return [PagePartition(k) for k in range(min(max(1, int(pages)), self.most))]

    def read(self, partition: PagePartition) -> Iterator[tuple[int, str]]:
        yield partition.page, self.fetched(partition.page)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> StructType | str:
        return "page int, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader({k.lower(): v for k, v in self.options.items()})
