"""Paged JSON sources as a Spark data source.

``fetch(cursor, limit, search)`` returns ``(items, next cursor)``; the one for
HTTP uses the standard library, tests pass a local one. Pages hang together by
their cursors, so one registry is one partition; several are read in parallel.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def http_page(url: str, cursor: str | None, limit: int, search: str | None, timeout: float = 30.0) -> tuple[list[dict], str | None]:
    """One page of a registry that answers ``{"servers": [...], "metadata": {"nextCursor": ...}}``."""
    asked = {k: v for k, v in (("cursor", cursor), ("limit", limit), ("search", search)) if v}
    with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(asked)}", timeout=timeout) as reply:
        body = json.load(reply)
    meta = body.get("metadata") or {}
    return body.get("servers") or body.get("data") or [], meta.get("nextCursor") or meta.get("next_cursor")


def file_page(url: str, cursor: str | None, limit: int, search: str | None) -> tuple[list[dict], str | None]:
    """The same from a JSON file of all items, for use without a network."""
    with open(url.removeprefix("file://"), encoding="utf-8") as f:
        items = [x for x in json.load(f) if not search or search.lower() in json.dumps(x).lower()]
    at = int(cursor or 0)
    return items[at : at + limit], str(at + limit) if at + limit < len(items) else None


class Registry(InputPartition):
    def __init__(self, url: str):
        self.url = url


class RegistryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [Registry(u) for u in self.options["urls"].split(",")]

    def read(self, partition):
        page = file_page if partition.url.startswith("file://") else http_page
        cursor, limit = None, int(self.options.get("limit", 30))
        while True:
            items, cursor = page(partition.url, cursor, limit, self.options.get("search"))
            for item in items:
                yield (partition.url, item.get("name"), json.dumps(item, sort_keys=True, ensure_ascii=False))
            if not cursor:
                return


class RegistrySource(DataSource):
    """``spark.read.format("registry").option("urls", ...).load()``; options ``limit`` and ``search``."""

    @classmethod
    def name(cls):
        return "registry"

    def schema(self):
        return "source string, name string, item string"

    def reader(self, schema):
        return RegistryReader(self.options)
