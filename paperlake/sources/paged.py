"""Paged listings of web services as a Spark data source, ``paged``.

In batch the pages are dealt out as ranges: the first page says how many items there are, and
each task fetches its own pages (``mode`` offset).  Listings that can only be followed from
page to page (cursor, next) are one task each; give several addresses for several tasks.  As
a stream the position is the stream's offset, which Spark stores in its checkpoint, so a run
that dies goes on at the page after the last committed one.

What is fetched is checked: a next page on another host, a loop, an answer without a list of
items and fewer items than declared are errors.  Loops are found with one remembered position
(Brent's method), however long the listing.  A transport is a function ``module:name`` of
(address, timeout) to the decoded answer; the default reads JSON over HTTP.  Temporary errors
(``OSError``) are tried again.

Options: ``url`` (one address, or several by line), ``mode``, ``items``, ``total``, ``next``
(dotted paths in an answer), ``page_size``, ``offset_name``, ``size_name``, ``cursor_name``
(query parameters), ``transport``, ``retries``, ``pause`` and ``timeout`` in seconds,
``pages_by_task``, and for streams ``pages_by_batch``.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "listing string, page int, ord int, item string"


def http_json(address: str, timeout: float) -> object:
    import urllib.error
    import urllib.request

    if urlsplit(address).scheme not in ("http", "https"):
        raise ValueError(f"not a web address: {address}")
    try:
        with urllib.request.urlopen(address, timeout=timeout) as answer:  # noqa: S310
            return json.load(answer)
    except urllib.error.HTTPError as error:
        if error.code < 500 and error.code != 429:  # trying again does not help
            raise ValueError(f"{error.code} for {address}") from None
        raise


class IncompleteListing(ValueError):
    """A listing that is not what it says it is."""


def _at(answer: object, path: str) -> object:
    for name in filter(None, path.split(".")):
        answer = answer.get(name) if isinstance(answer, dict) else None
    return answer


def _with(address: str, **values: object) -> str:
    parts = urlsplit(address)
    kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k not in values]
    return urlunsplit(parts._replace(query=urlencode([*kept, *((k, str(v)) for k, v in values.items())])))


class Client:
    """Fetches the pages of listings as the options say."""

    def __init__(self, options: dict[str, str]) -> None:
        get = lambda name, default: options.get(name, default)
        self.mode, self.items, self.total, self.next = get("mode", "offset"), get("items", "results"), get("total", "count"), get("next", "next")
        if self.mode not in ("offset", "cursor", "next"):
            raise ValueError(f"unknown mode {self.mode}")
        self.size = int(get("page_size", "100"))
        self.offset_name, self.size_name, self.cursor_name = get("offset_name", "offset"), get("size_name", "limit"), get("cursor_name", "cursor")
        self.retries, self.pause, self.timeout = int(get("retries", "3")), float(get("pause", "0.5")), float(get("timeout", "30"))
        self.pages_by_task, self.pages_by_batch = int(get("pages_by_task", "20")), int(get("pages_by_batch", "100"))
        self.listings = [u.strip() for u in options.get("url", "").splitlines() if u.strip()]
        if not self.listings:
            raise ValueError("the paged source needs a url")
        self.transport_name = get("transport", f"{__name__}:http_json")

    def transport(self) -> Callable[[str, float], object]:
        module, _, name = self.transport_name.partition(":")
        return getattr(importlib.import_module(module), name)

    def fetch(self, address: str) -> tuple[list, object]:
        """The items of a page and its answer."""
        for tries in range(self.retries + 1):
            try:
                answer = self.transport()(address, self.timeout)
                break
            except OSError:
                if tries == self.retries:
                    raise
                time.sleep(self.pause * 2**tries)
        found = _at(answer, self.items)
        if not isinstance(found, list):
            raise IncompleteListing(f"no list of items at {address}")
        return found, answer

    def declared(self, answer: object) -> int | None:
        n = _at(answer, self.total)
        return n if isinstance(n, int) and not isinstance(n, bool) else None

    def first(self, listing: str) -> str:
        if self.mode == "offset":
            return self.page(listing, 0)
        return _with(listing, **{self.cursor_name: "*", self.size_name: self.size}) if self.mode == "cursor" else listing

    def page(self, listing: str, number: int) -> str:
        return _with(listing, **{self.offset_name: number * self.size, self.size_name: self.size})

    def following(self, listing: str, address: str, number: int, found: list, answer: object) -> str | None:
        """The address of the page after this one; None after the last."""
        if self.mode == "offset":
            return self.page(listing, number + 1) if len(found) >= self.size else None
        link = _at(answer, self.next)
        if not isinstance(link, str) or not link.strip():
            return None
        if self.mode == "cursor":
            return _with(address, **{self.cursor_name: link})
        after = urljoin(address, link.strip())
        if (urlsplit(after).hostname or "").lower() != (urlsplit(listing).hostname or "").lower():
            raise IncompleteListing(f"the next page is on another host: {after}")
        return after


@dataclass
class Walk:
    """A position in a listing, small enough to be stored: the next address, pages and items
    so far, the declared number of items, and the remembered address of the loop test."""

    address: str | None
    pages: int = 0
    items: int = 0
    declared: int | None = None
    anchor: str | None = None
    power: int = 1

    def step(self, client: Client, listing: str) -> list:
        """Fetches the next page and moves on; its items."""
        if self.address == self.anchor:
            raise IncompleteListing(f"a loop of pages at {self.address}")
        if self.pages == self.power:  # remember a place at each power of two
            self.anchor, self.power = self.address, 2 * self.power
        found, answer = client.fetch(self.address)
        if self.declared is None:
            self.declared = client.declared(answer)
        after = client.following(listing, self.address, self.pages, found, answer)
        if after == self.address:
            raise IncompleteListing(f"a page that follows itself: {after}")
        self.pages, self.items, self.address = self.pages + 1, self.items + len(found), after
        if after is None and self.declared is not None and self.items != self.declared:
            raise IncompleteListing(f"{self.items} items of {self.declared} in {listing}")
        return found


def _rows(listing: str, number: int, found: list) -> Iterator[tuple]:
    for i, item in enumerate(found):
        yield listing, number, i, json.dumps(item, ensure_ascii=False, sort_keys=True)


@dataclass
class Pages(InputPartition):
    """A range of pages with ``expected`` items, or a whole listing to be followed; after the
    ``closing`` range nothing may come."""

    listing: str
    first: int
    last: int | None
    expected: int | None = None
    closing: bool = False


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.client = Client(options)

    def partitions(self) -> list[Pages]:
        out = []
        for listing in self.client.listings:
            total = None
            if self.client.mode == "offset":
                _, answer = self.client.fetch(self.client.first(listing))
                total = self.client.declared(answer)
            if total is None:
                out.append(Pages(listing, 0, None))
                continue
            size, step = self.client.size, self.client.pages_by_task
            pages = max(1, -(-total // size))
            for a in range(0, pages, step):
                b = min(a + step, pages)
                out.append(Pages(listing, a, b, min(b * size, total) - a * size, b == pages and total % size == 0))
        return out

    def read(self, partition: Pages) -> Iterator[tuple]:
        if partition.last is None:
            walk = Walk(self.client.first(partition.listing))
            while walk.address is not None:
                number = walk.pages
                yield from _rows(partition.listing, number, walk.step(self.client, partition.listing))
            return
        n = 0
        for number in range(partition.first, partition.last):
            found, _ = self.client.fetch(self.client.page(partition.listing, number))
            n += len(found)
            yield from _rows(partition.listing, number, found)
        if partition.closing and partition.last > 0 and partition.expected:
            n += len(self.client.fetch(self.client.page(partition.listing, partition.last))[0])
        if n != partition.expected:
            raise IncompleteListing(f"{n} items of {partition.expected} in pages {partition.first} to {partition.last - 1} of {partition.listing}")


class Stream(SimpleDataSourceStreamReader):
    """Follows the listings one after the other, some pages for each batch."""

    def __init__(self, options: dict[str, str]) -> None:
        self.client = Client(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listing": 0, "walk": json.dumps(Walk(self.client.first(self.client.listings[0])).__dict__)}

    def _pages(self, start: dict, pages: int, until: dict | None = None) -> tuple[list[tuple], dict]:
        at, walk, rows = int(start["listing"]), Walk(**json.loads(start["walk"])), []
        while at < len(self.client.listings) and pages > 0 and until != {"listing": at, "walk": json.dumps(walk.__dict__)}:
            if walk.address is None:
                at += 1
                walk = Walk(self.client.first(self.client.listings[at])) if at < len(self.client.listings) else walk
                continue
            number = walk.pages
            rows += _rows(self.client.listings[at], number, walk.step(self.client, self.client.listings[at]))
            pages -= 1
        return rows, {"listing": at, "walk": json.dumps(walk.__dict__)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._pages(start, self.client.pages_by_batch)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """The pages of a batch once more, after a failure."""
        rows, reached = self._pages(start, 1 << 60, end)
        if reached != end:
            raise IncompleteListing(f"the listing has changed: {reached} for {end}")
        return iter(rows)


class Paged(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> Reader:
        return Reader(dict(self.options))

    def simpleStreamReader(self, schema: object) -> Stream:  # noqa: N802
        return Stream(dict(self.options))


def paged(spark: SparkSession, urls: list[str], **options: object) -> DataFrame:
    """(listing, page, ord, item) of listings, each item as JSON."""
    spark.dataSource.register(Paged)
    return spark.read.format("paged").options(url="\n".join(urls), **{k: str(v) for k, v in options.items()}).load()


def paged_stream(spark: SparkSession, urls: list[str], **options: object) -> DataFrame:
    """The same as a stream, whose checkpoint holds the position."""
    spark.dataSource.register(Paged)
    return spark.readStream.format("paged").options(url="\n".join(urls), **{k: str(v) for k, v in options.items()}).load()
