"""A data source of pages: an interface that gives JSON lists page by page, as batches and as a stream.

``pages(spark, schema, ...)`` reads it; ``register(spark)`` makes it known to a session's
``readStream.format("lumenspan_pages")``. Options:

``url``         template with ``{page}`` (from 1), ``{per_page}`` and ``{keys}`` (quoted, joined by commas);
                ``http(s)://`` or a path of a file
``key``         column whose values go into ``{keys}``; they come from filters on it, else from ``keys``
``keys``        JSON list of values that are asked for where no filter names any
``chunk``       keys of one request (1); each chunk is a partition
``per_page``    rows of a full page (100); a page with fewer is the last
``field``       name of the list where a page is an object
``header.*``    headers of a request, ``retries`` (2) of one that fails by the server's fault

Equality and IN on ``key`` reach the requests, other filters stay with Spark. A row without the key gets
that of its request where this has one. Fields that a row lacks are null; objects and lists in a text
column are JSON. A page that isn't there (404) is empty.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import ArrayType, DataType, DateType, DoubleType, FloatType, IntegralType, MapType, StringType, StructType, TimestampType

from lumenspan.functions.workers import ship

NAME = "lumenspan_pages"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Request(InputPartition):
    """What one task asks for: pages from ``first`` on, up to ``end`` where one is set."""

    keys: tuple[str, ...] = ()
    first: int = 1
    end: int | None = None
    skip: int = 0
    take: int | None = None


class Client:
    """Fetches pages of one interface."""

    def __init__(self, options: dict[str, str]) -> None:
        low = {k.lower(): v for k, v in options.items()}
        if "url" not in low:
            raise ValueError("pages need the option url")
        self.url, self.field = low["url"], low.get("field")
        self.per_page, self.retries = int(low.get("per_page", 100)), int(low.get("retries", 2))
        self.headers = {k[len("header.") :]: v for k, v in options.items() if k.lower().startswith("header.")}

    def page(self, keys: Sequence[str], number: int) -> list:
        quoted = ",".join(urllib.parse.quote(k, safe="/") for k in keys)
        url = self.url.replace("{page}", str(number)).replace("{per_page}", str(self.per_page)).replace("{keys}", quoted)
        text = self._get(url)
        if not text:
            return []
        got = json.loads(text)
        rows = got.get(self.field, []) if self.field and isinstance(got, dict) else got
        return rows if isinstance(rows, list) else [rows]

    def _get(self, url: str) -> str | None:
        if not url.startswith(("http://", "https://")):
            from lumenspan.sources.sinks import filesystem

            store, place = filesystem(url)
            try:
                with store.open_input_stream(place) as file:
                    return file.read().decode()
            except FileNotFoundError:
                return None
        for again in range(self.retries + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers=self.headers), timeout=60) as reply:
                    return reply.read().decode()
            except urllib.error.HTTPError as error:
                if error.code == 404:
                    return None
                if error.code < 500 and error.code != 429 or again == self.retries:
                    raise
                time.sleep(0.2 * 2**again)
        return None

    def rows(self, asked: Request) -> Iterator[dict]:
        """Rows of a request, from page to page until one isn't full."""
        number, skip, left = asked.first, asked.skip, asked.take
        while left is None or left > 0:
            page = self.page(asked.keys, number)
            part = page[skip:] if left is None else page[skip : skip + left]
            yield from part
            left = None if left is None else left - len(part)
            if len(page) < self.per_page or asked.end is not None and number + 1 >= asked.end:
                return
            number, skip = number + 1, 0


def value(raw: object, kind: DataType) -> object:
    """A value of JSON as one of a column's type; null where it can't be."""
    if raw is None:
        return None
    if isinstance(kind, StringType):
        return raw if isinstance(raw, str) else json.dumps(raw)
    if isinstance(kind, StructType):
        return tuple(value(raw.get(f.name), f.dataType) for f in kind.fields) if isinstance(raw, dict) else None
    if isinstance(kind, ArrayType):
        return [value(x, kind.elementType) for x in raw] if isinstance(raw, list) else None
    if isinstance(kind, MapType):
        return {k: value(x, kind.valueType) for k, x in raw.items()} if isinstance(raw, dict) else None
    if isinstance(kind, (DateType, TimestampType)):
        raise ValueError("read dates and times of pages as text and cast them")
    try:
        if isinstance(kind, IntegralType):
            return int(raw)
        return float(raw) if isinstance(kind, (FloatType, DoubleType)) else raw
    except (TypeError, ValueError):
        return None


class _Reading:
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.options = schema, dict(options)
        self.key = self.options.get("key")
        self.client = Client(self.options)

    def read(self, partition: Request) -> Iterator[tuple]:
        for row in self.client.rows(partition):
            if not isinstance(row, dict):
                continue
            if self.key and self.key not in row and len(partition.keys) == 1:
                row = {**row, self.key: partition.keys[0]}
            yield tuple(value(row.get(f.name), f.dataType) for f in self.schema.fields)


class PagesReader(_Reading, DataSourceReader):
    """Reads whole pages; a partition for each chunk of keys."""

    names: list[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if self.key and isinstance(f, (EqualTo, EqualNullSafe, In)) and f.attribute == (self.key,):
                own = {str(v) for v in (f.value if isinstance(f, In) else [f.value]) if v is not None}
                self.names = sorted(own if self.names is None else own & set(self.names))
            yield f  # the server may give more than was asked for

    def partitions(self) -> Sequence[Request]:
        names = self.names if self.names is not None else json.loads(self.options["keys"]) if "keys" in self.options else None
        if names is None:
            if "{keys}" in self.client.url:
                raise ValueError(f"name the keys to ask for: by a filter on {self.key!r} or the option keys")
            return [Request()]
        chunk = int(self.options.get("chunk", 1))
        return [Request(tuple(names[at : at + chunk])) for at in range(0, len(names), chunk)] or [Request(end=0, take=0)]


class PagesStream(_Reading, DataSourceStreamReader):
    """New rows of pages that only grow; the offset is the number of rows that have been seen."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"rows": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        keys, seen = self._keys(), getattr(self, "seen", 0)
        number = seen // self.client.per_page + 1
        while (n := len(self.client.page(keys, number))) == self.client.per_page:
            number += 1
        self.seen = max(seen, (number - 1) * self.client.per_page + n)
        return {"rows": self.seen}

    def _keys(self) -> tuple[str, ...]:
        return tuple(json.loads(self.options.get("keys", "[]")))

    def partitions(self, start: dict, end: dict) -> Sequence[Request]:
        per, out, at = self.client.per_page, [], start["rows"]
        self.seen = max(getattr(self, "seen", 0), end["rows"])
        while at < end["rows"]:  # a task a page
            to = min(end["rows"], (at // per + 1) * per)
            out.append(Request(self._keys(), at // per + 1, at // per + 2, at % per, to - at))
            at = to
        return out


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError("give pages a schema")

    def reader(self, schema: StructType) -> PagesReader:
        return PagesReader(schema, self.options)

    def streamReader(self, schema: StructType) -> PagesStream:  # noqa: N802
        return PagesStream(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters reach sources in Python."""
    ship(spark)
    spark.dataSource.register(Pages)
    spark.conf.set(PUSHDOWN, "true")


def pages(spark: SparkSession, schema: str, **options: str | int) -> DataFrame:
    """Rows of pages. Rows whose ``key`` is null are left out where one is named.

    Spark keeps what the filters of a table's last query have left for its next one without any; with
    a filter on the key that is always there, each query has its own.
    """
    register(spark)
    rows = spark.read.format(NAME).schema(schema).options(**options).load()
    return rows.where(F.col(options["key"]).isNotNull()) if "key" in options else rows
