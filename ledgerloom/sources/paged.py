"""A data source for services that give JSON results page by page."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fetch(url: str, tries: int = 4, wait: float = 0.5) -> dict:
    """A page; asked again, with growing waits, where the service is busy or fails. An unknown page is an error."""
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=30) as answer:  # noqa: S310
                return json.load(answer)
        except urllib.error.HTTPError as error:
            if error.code not in (429, 500, 502, 503, 504) or attempt == tries - 1:
                raise
        except urllib.error.URLError:
            if attempt == tries - 1:
                raise
        time.sleep(wait * 2**attempt)
    raise AssertionError("unreachable")


class PagedJson(DataSource):
    """Options: ``url`` with {skip} and {limit}, ``total`` rows, ``limit`` of a page (100), and ``most``, what the service gives.

    Each page is a partition, so pages are fetched in parallel and a lost one is fetched again. A row is the result's JSON
    text in ``record`` with its page in ``skip``. Nothing is left out: more rows than ``most`` (unset: any number) are an
    error before the first page is asked for, and so is a page with fewer or more results than belong there.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "skip bigint, record string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.limit = options["url"], int(options.get("limit", 100))
        self.total = int(options["total"])
        if "most" in options and self.total > int(options["most"]):
            raise ValueError(f"{self.total} rows, but the service gives {options['most']} at most: ask for them in parts")

    def partitions(self):
        return [InputPartition(skip) for skip in range(0, self.total, self.limit)]

    def read(self, partition):
        page = fetch(self.url.replace("{skip}", str(partition.value)).replace("{limit}", str(self.limit)))
        results, expected = page.get("results", []), min(self.limit, self.total - partition.value)
        if len(results) != expected:
            raise ValueError(f"page {partition.value}: {len(results)} results of {expected}")
        for record in results:
            yield partition.value, json.dumps(record, ensure_ascii=False)


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("paged_json")`` known."""
    spark.dataSource.register(PagedJson)
