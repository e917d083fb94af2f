"""Tables behind a service that hands them out page by page, as a Spark data source.

    register(spark)
    spark.read.format("paged").schema("id long, name string").option("path", "/data/pages").load()

A page is asked for by offset and limit in a fixed order.  ``path`` is a folder with one
JSON array a page, named by its offset (``0.json``, ``1000.json``), or an address with
``{offset}``, ``{limit}``, ``{order}`` and ``{select}``.  Ranges of pages are partitions, so
pages are fetched in parallel; a range ends at the first page that is short or fails.

A page that fails is no end of the data: it makes the result incomplete, as does reaching
the limit of pages.  ``read_pages`` tells whether a result is whole, and ``whole`` refuses
one that is not, so that nothing is published from half a table.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

PAGE_ROWS, MOST_PAGES, RANGE_PAGES = 1000, 50, 5
#: What a page says of itself, beside its rows: its number, its place in it (null for the page's own row) and what failed.
PAGE, PLACE, ROWS, ERROR = "page__", "place__", "rows__", "error__"
STATUS = f"{PAGE} long, {PLACE} long, {ROWS} long, {ERROR} string"


class IncompleteError(RuntimeError):
    """A table that was not read to its end."""


@dataclass
class Range(InputPartition):
    first: int
    last: int


def fetched(path: str, offset: int, limit: int, order: str, select: str) -> list[dict]:
    """The rows of one page; anything but a JSON array of objects is an error."""
    if "{offset}" in path:
        with urlopen(path.format(offset=offset, limit=limit, order=order, select=select), timeout=30) as answer:
            rows = json.load(answer)
    else:
        with open(os.path.join(path, f"{offset}.json"), encoding="utf-8") as f:
            rows = json.load(f)
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise ValueError("a page is an array of objects")
    return rows


_TESTS = {
    EqualTo: lambda a, b: a is not None and a == b,
    GreaterThan: lambda a, b: a is not None and a > b,
    GreaterThanOrEqual: lambda a, b: a is not None and a >= b,
    LessThan: lambda a, b: a is not None and a < b,
    LessThanOrEqual: lambda a, b: a is not None and a <= b,
    In: lambda a, b: a is not None and a in b,
    IsNotNull: lambda a, _: a is not None,
}


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.rows = int(options.get("pageRows", PAGE_ROWS))
        self.most = int(options.get("mostPages", MOST_PAGES))
        self.each = int(options.get("rangePages", RANGE_PAGES))
        self.order = options.get("order", "id.asc")
        self.filters: list = []

    def pushFilters(self, filters) -> Iterator:  # noqa: N802
        """Plain comparisons of a column are taken here, so that rows they drop never leave the Python worker; the others go back to Spark."""
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] not in (PAGE, PLACE, ROWS, ERROR):
                self.filters.append((_TESTS[type(f)], f.attribute[0], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Range]:
        return [Range(a, min(a + self.each, self.most)) for a in range(0, self.most, self.each)]

    def read(self, partition: Range) -> Iterator[tuple]:
        """A page's rows, and, where the schema asks for it, one row more with what the page says of itself."""
        names = [f.name for f in self.schema.fields]
        select = ",".join(n for n in names if n not in (PAGE, PLACE, ROWS, ERROR))
        for page in range(partition.first, partition.last):
            try:
                rows, error = fetched(self.path, page * self.rows, self.rows, self.order, select), None
            except Exception as e:  # noqa: BLE001  whatever a service does wrong is told, not raised
                rows, error = [], f"{type(e).__name__}: {e}"[:500]
            own = {PAGE: page, ROWS: len(rows), ERROR: error}
            if PAGE in names:
                yield tuple(own.get(n) for n in names)
            elif error and not (isinstance(error, str) and error.startswith("FileNotFoundError")):
                raise IncompleteError(f"page {page}: {error}")
            for place, row in enumerate(rows):
                if all(test(row.get(c), v) for test, c, v in self.filters):
                    yield tuple((own | {PLACE: place} | row).get(n) for n in names)
            if error or len(rows) < self.rows:
                return


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("give the schema of the rows with .schema(...)")

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make format "paged" known to a session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)


def read_pages(spark: SparkSession, path: str, schema: str, **options) -> tuple[DataFrame, bool, int]:
    """(rows, whether they are all, pages read): each page is fetched once, and what came is written.

    All rows are there if every page up to the first short one is there and full, none
    failed, and a short one came before the limit of pages.
    """
    from granary.operators.graph import written

    register(spark)
    staged = spark.read.format("paged").schema(f"{schema}, {STATUS}").option("path", path).options(**{k: str(v) for k, v in options.items()}).load()
    staged = written(staged)
    size = int(options.get("pageRows", PAGE_ROWS))
    pages = staged.filter(F.col(PLACE).isNull() & F.col(ROWS).isNotNull())
    ends = F.min(F.when((F.col(ROWS) < size) & F.col(ERROR).isNull(), F.col(PAGE)))
    last = pages.agg(ends.alias("last")).first()["last"]
    until = pages.filter(F.col(PAGE) <= last) if last is not None else pages
    told = until.agg(F.count("*").alias("n"), F.count(ERROR).alias("failed")).first()
    complete = last is not None and told["failed"] == 0 and told["n"] == last + 1
    rows = staged.filter(F.col(PLACE).isNotNull())
    rows = rows.filter(F.col(PAGE) <= last) if complete else rows
    return rows.drop(PAGE, PLACE, ROWS, ERROR), complete, told["n"]


def whole(result: tuple[DataFrame, bool, int]) -> DataFrame:
    """The rows of read_pages(), if they are all."""
    rows, complete, pages = result
    if not complete:
        raise IncompleteError(f"only {pages} pages were read; nothing may be published from them")
    return rows
