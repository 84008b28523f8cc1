"""Sources: files with explicit schemas, and a paged REST table as a Python data source.

``PagedTable`` reads a table that a service gives out in pages; each page is a partition of its own, and equality filters are
pushed to the service.  The fetcher is chosen by an option, so that tests and offline runs read fixtures from files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

JUNCTIONS = "junction_id string, latitude double, longitude double, governorate string, ways_count int, tier int, junction_idx int"
READINGS = "junction_id string, recorded_at timestamp, jam_factor double, current_speed double, free_flow_speed double, congestion_ratio double, speed_reduction double, delay_seconds int, confidence double, hour int, day_of_week int, is_weekend boolean, is_friday boolean, scan_trigger string"


def junctions(spark: SparkSession, path: str) -> DataFrame:
    """The junction dimension from CSV, with its schema given and never inferred."""
    return spark.read.schema(JUNCTIONS).csv(path, header=True)


def combined(spark: SparkSession, path: str | None, real: DataFrame) -> DataFrame:
    """Real and virtual junctions; without a combined file the real ones alone."""
    if path:
        return spark.read.schema(JUNCTIONS + ", junction_type string, road_name string").csv(path, header=True)
    return real.withColumns({"junction_type": F.lit("real"), "road_name": F.lit("")})


def readings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(READINGS).csv(path, header=True)


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class PagedTable(DataSource):
    """Options: url (http(s): or file: template with {page}), size (rows of a full page), token (a header, from the caller's environment only).

    With ``pages`` each page is a partition; without, tasks of ``step`` (8) each take every so manieth page and stop at the first short one.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_table"

    def schema(self) -> str:
        return self.options.get("columns", "id long")

    def reader(self, schema: StructType) -> "PagedReader":
        return PagedReader(schema, dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.options, self.equal = [f.name for f in schema.fields], options, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1:
                self.equal[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[Page]:
        return [Page(k) for k in range(int(self.options.get("pages", self.options.get("step", 8))))]

    def read(self, partition: Page) -> Iterator[tuple]:
        if "pages" in self.options:
            yield from self._matching(self._page(partition.number) or [])
            return
        number, size = partition.number, int(self.options.get("size", 1000))
        while True:
            rows = self._page(number)
            yield from self._matching(rows or [])
            if rows is None or len(rows) < size:
                return
            number += int(self.options.get("step", 8))

    def _matching(self, rows: list[dict]) -> Iterator[tuple]:
        for row in rows:
            if all(row.get(k) == v for k, v in self.equal.items()):
                yield tuple(row.get(n) for n in self.names)

    def _page(self, number: int) -> list[dict] | None:
        """The rows of a page; none beyond the last."""
        url = self.options["url"].format(page=number)
        request = Request(url, headers={"Authorization": f"Bearer {self.options['token']}"} if self.options.get("token") else {})
        try:
            with urlopen(request, timeout=30) as answer:
                return json.load(answer)
        except HTTPError as e:
            if e.code in (404, 416):
                return None
            raise
        except URLError as e:
            if url.startswith("file:") and isinstance(e.reason, (FileNotFoundError, str)):
                return None
            raise


def register(spark: SparkSession) -> None:
    """Makes the source known, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedTable)
