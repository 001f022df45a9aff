"""A paged REST listing as a data source: one partition for each page, read in parallel."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.url = schema, options["url"]
        self.total, self.size = int(options.get("total", -1)), int(options.get("pagesize", 100))
        self.items, self.count, self.timeout = options.get("items", "items"), options.get("totalfield", "total"), float(options.get("timeout", 12))
        self.first = int(options.get("firstpage", 1))

    def page(self, number: int) -> dict:
        with urlopen(self.url.replace("{page}", str(number)), timeout=self.timeout) as answer:
            return json.load(answer)

    def partitions(self) -> list[Page]:
        """Pages from the first to that which the total, told by an option or by the first page, asks for."""
        total = self.total if self.total >= 0 else int(self.page(self.first)[self.count])
        return [Page(self.first + k) for k in range(-(-total // self.size))]

    def read(self, partition: Page) -> Iterator[tuple]:
        """A page's items; a page that is missing or isn't JSON is an error."""
        for item in self.page(partition.number)[self.items]:
            yield tuple(None if (v := item.get(f.name)) is None else v if not isinstance(v, (dict, list)) else json.dumps(v) for f in self.schema.fields)


class Paged(DataSource):
    """spark.dataSource.register(Paged); spark.read.format("paged_rest").schema(...).options(url="https://h/items?page={page}", pageSize=100).load()

    Options: url with `{page}`, pageSize, total (else field `total` of the first page, or that which totalField names), items (the field of the
    list), firstPage, timeout. Columns are fields of the items by name, null where absent; nested values are JSON.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, {k.lower(): v for k, v in self.options.items()})
