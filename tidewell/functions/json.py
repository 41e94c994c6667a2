"""Recursive JSON operations that Spark has no function for, as Arrow functions on columns."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merge(base, patch):
    """Objects merge into one another; anything else, nulls and arrays too, replaces."""
    if isinstance(base, dict) and isinstance(patch, dict):
        return base | {k: merge(base[k], v) if k in base else v for k, v in patch.items()}
    return patch


def without_empty(value):
    """No nulls and empty containers in objects, at any depth; array elements stay."""
    if isinstance(value, dict):
        inner = {k: without_empty(v) for k, v in value.items()}
        return {k: v for k, v in inner.items() if v is not None and v != {} and v != []}
    return [without_empty(v) for v in value] if isinstance(value, list) else value


def connection_part(config: dict, default_timeout: int = 60_000) -> dict:
    """What of a server's settings a connection depends on."""
    out = {k: v for k, v in config.items() if k not in ("id", "name", "description")}
    options = out.get("options")
    if isinstance(options, dict) and options.get("timeout") == default_timeout:
        out["options"] = {k: v for k, v in options.items() if k != "timeout"}
    return without_empty(out)


def base_url(spec: dict) -> str | None:
    """Where an API description says it is served."""
    first = (spec.get("servers") or [None])[0] if isinstance(spec.get("servers"), list) else None
    url = first.get("url") if isinstance(first, dict) else None
    if isinstance(url, str) and url:
        for name, variable in (first.get("variables") or {}).items():
            if isinstance(variable, dict) and isinstance(variable.get("default"), str):
                url = url.replace("{" + name + "}", variable["default"])
        if url.startswith("/"):
            return "http://localhost" + url
        if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", url):
            return url
    if isinstance(spec.get("host"), str):
        schemes = spec.get("schemes")
        scheme = schemes[0] if isinstance(schemes, list) and schemes and isinstance(schemes[0], str) else "https"
        return f"{scheme}://{spec['host']}{spec.get('basePath') or ''}"
    own = spec.get("x-base-url")
    return own if isinstance(own, str) and re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", own) else None


def _load(text):
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def _dump(value) -> str | None:
    return None if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def deep_merge(base: pd.Series, patch: pd.Series) -> pd.Series:
    """Settings with a patch merged in; a broken patch changes nothing, broken settings count as empty."""
    out = []
    for b, p in zip(base, patch, strict=True):
        old, new = _load(b), _load(p)
        out.append(_dump((old or {}) if new is None else merge(old if isinstance(old, dict) else {}, new)))
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def strip_empty(value: pd.Series) -> pd.Series:
    return value.map(lambda v: _dump(without_empty(_load(v))))


@F.pandas_udf(T.BooleanType())
def connection_changed(before: pd.Series, after: pd.Series) -> pd.Series:
    """Whether a change of settings needs a new connection."""
    both = zip(before, after, strict=True)
    return pd.Series([connection_part(_load(b) or {}) != connection_part(_load(a) or {}) for b, a in both])


@F.pandas_udf(T.StringType())
def api_base_url(spec: pd.Series) -> pd.Series:
    return spec.map(lambda s: base_url(v) if isinstance(v := _load(s), dict) else None)


def with_default(text: Column, path: str, default: str) -> Column:
    """Value at a path of a JSON text, or the default where it is missing or null."""
    return F.coalesce(F.get_json_object(text, path), F.lit(default))
