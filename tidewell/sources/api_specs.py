"""Descriptions of APIs: given inline, or fetched from their address."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Fetch = Callable[[str, dict[str, str]], str]


def http_text(url: str, headers: dict[str, str], timeout: float = 30.0) -> str:
    """The body at an address; a status that is no success raises."""
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as reply:
        return reply.read().decode()


def _as_json(text: str) -> str:
    return json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False)


def load_specs(servers: DataFrame, fetch: Fetch = http_text) -> DataFrame:
    """``(name, spec, origin, error)`` of servers ``(name, spec_schema, spec_url, headers)``.

    An inline description wins and nothing is fetched then. What can't be fetched or isn't JSON has an error in its
    own row and stops no other; a server without either says so. Rows are fetched by the tasks they are in.
    """

    def one(inline: str | None, url: str | None, headers) -> tuple[str | None, str | None, str | None]:
        if inline:
            try:
                return _as_json(inline), "inline", None
            except ValueError as e:
                return None, "inline", f"not JSON: {e}"
        if not url:
            return None, None, "no spec_url or spec_schema configured"
        try:
            return _as_json(fetch(url, dict(headers or {}))), "url", None
        except urllib.error.HTTPError as e:
            return None, "url", f"HTTP {e.code}"
        except ValueError as e:
            return None, "url", f"not JSON: {e}"
        except Exception as e:  # noqa: BLE001 - whatever a fetch fails of, the other servers go on
            return None, "url", f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, *one(i, u, h)) for n, i, u, h in zip(b["name"], b["spec_schema"], b["spec_url"], b["headers"], strict=True)]
            yield pd.DataFrame(rows, columns=["name", "spec", "origin", "error"])

    return servers.select("name", "spec_schema", "spec_url", "headers").mapInPandas(run, "name string, spec string, origin string, error string")
