"""Catalogs of servers and other items: search, facets, counters, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import fold_ascii, fold_ascii_text, redact_env, strip
from tidewell.plans.mutations import insert_missing


def holds(query: str, *columns: str, trim: bool = True) -> Column:
    """Whether a lower-cased query, trimmed or as it is, is in one of the columns; an empty one is in all."""
    q = (query.strip() if trim else query).lower()
    out = F.lit(not q)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False))
    return out


def search(items: DataFrame, query: str | None = None, category: str | None = None, tag: str | None = None) -> DataFrame:
    """Items by text in name, display name or description, and exact category and tag.

    The query counts with its blanks; what is empty or None filters nothing.
    """
    out = items.where(holds(query, "name", "display_name", "description", trim=False)) if query else items
    if category:
        out = out.where(F.array_contains("categories", category))
    return out.where(F.array_contains("tags", tag)) if tag else out


def cloud_search(servers: DataFrame, query: str | None = None) -> DataFrame:
    """Listed servers with the query, as it is but for case, in name or description."""
    return servers.where(holds(query or "", "name", "description", trim=False))


def of_type(servers: DataFrame, which: str = "custom") -> DataFrame:
    """``custom`` hides builtin servers, a server without a type is custom; ``builtin`` shows only them, ``all`` both."""
    builtin = F.coalesce(F.col("server_type") == "builtin", F.lit(False))
    return servers if which == "all" else servers.where(builtin if which == "builtin" else ~builtin)


def without_reserved(servers: DataFrame, reserved: list[str], column: str = "name") -> DataFrame:
    """Servers whose name isn't reserved; case within ASCII doesn't count."""
    return servers.where(~fold_ascii(column).isin([fold_ascii_text(r) for r in reserved]))


def export_entry(name: Column, env: Column) -> Column:
    """A server as JSON for an export, secrets of its environment masked."""
    return F.to_json(F.struct(name.alias("name"), redact_env(env).alias("env")))


def import_new(before: DataFrame, entries: DataFrame, on: list[str], allowed: list[str] | None = None, column: str = "entry") -> DataFrame:
    """The table after an import: entries with a known key, or with map keys that aren't allowed, are passed by."""
    if allowed is not None:
        entries = unknown_keys(entries, allowed, column).where(F.coalesce(F.size("unknown"), F.lit(0)) == 0).drop("unknown")
    return insert_missing(before, entries.select(*before.columns), on)


def facet_values(items: DataFrame, column: str) -> DataFrame:
    """Distinct elements of an array column, ordered."""
    return items.select(F.explode(column).alias(column.rstrip("s"))).distinct().orderBy(column.rstrip("s"))


def filter_servers(servers: DataFrame, which: str = "all", query: str = "") -> DataFrame:
    """Servers ``(name, status, enabled, description, tools array)`` of a status tab and search text."""
    off = F.coalesce(~F.col("enabled"), F.lit(False))
    keep = {"online": F.col("status") == "connected", "issues": (F.col("status") != "connected") & ~off, "disabled": off}.get(which, F.lit(True))
    text = F.lower(F.concat_ws(" ", "name", F.coalesce("description", F.lit("")), F.array_join(F.coalesce("tools", F.array().cast("array<string>")), " ")))
    return servers.where(keep & F.contains(text, F.lit(query.strip().lower())))


def server_facets(servers: DataFrame) -> DataFrame:
    """Counts of the tabs; they overlap."""
    up, off = F.col("status") == "connected", F.coalesce(~F.col("enabled"), F.lit(False))
    return servers.agg(F.count("*").alias("all"), F.count_if(up).alias("online"), F.count_if(~up & ~off).alias("issues"), F.count_if(off).alias("disabled"))


def dashboard(servers: DataFrame) -> DataFrame:
    """Totals by state, and all tools."""
    on = F.coalesce(F.col("enabled"), F.lit(True))
    return servers.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "connected").alias("online"), F.count_if(~on).alias("disabled"),
        F.count_if((F.col("status") == "disconnected") & on).alias("offline"), F.count_if(F.col("status").isin("connecting", "oauth_required") & on).alias("connecting"),
        F.coalesce(F.sum(F.col("n_tools")), F.lit(0)).cast("bigint").alias("tools"),
    )


def item_facets(items: DataFrame) -> DataFrame:
    on = F.coalesce(F.col("enabled"), F.lit(True))
    return items.agg(F.count("*").alias("all"), F.count_if(on).alias("active"), F.count_if(~on).alias("inactive"))


def filter_items(items: DataFrame, which: str = "all", query: str = "", columns: tuple[str, ...] = ("name", "description")) -> DataFrame:
    on = F.coalesce(F.col("enabled"), F.lit(True))
    out = items.where(on if which == "active" else ~on if which == "inactive" else F.lit(True))
    return out.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.strip().lower())))


def keys_in_scope(keys: DataFrame, scope: str = "all") -> DataFrame:
    """``all``, ``system`` (no owner) or ``user:<owner>``."""
    owner = strip(F.coalesce("owner", F.lit("")))
    if scope.startswith("user:"):
        return keys.where(owner == scope[5:])
    return keys.where(owner == "") if scope == "system" else keys


def owners(keys: DataFrame, known: list[str] | None = None) -> DataFrame:
    """Trimmed, distinct, non-empty owners; known ones first, then by name."""
    o = keys.select(strip("owner").alias("owner")).where("owner <> ''").distinct()
    return o.orderBy(F.when(F.col("owner").isin(known or [""]), 0).otherwise(1), "owner")


def by_name_or_id(df: DataFrame, value: str) -> DataFrame:
    return df.where((F.col("name") == value) | (F.col("id") == value))


def with_status(servers: DataFrame, statuses: DataFrame) -> DataFrame:
    """Servers with their runtime state, ``disconnected`` and no tools where none is known."""
    out = servers.join(statuses, "name", "left")
    return out.withColumns({"status": F.coalesce("status", F.lit("disconnected")), "n_tools": F.coalesce("n_tools", F.lit(0).cast("bigint"))})


def apply_overrides(tools: DataFrame, overrides: DataFrame) -> DataFrame:
    """Tools with what their override says: always its switch, its description if it has one."""
    own = overrides.where(F.col("item_type") == "tool").select("server_name", F.col("item_name").alias("name"), F.col("enabled").alias("o_enabled"), F.col("description").alias("o_description"))
    out = tools.join(own, ["server_name", "name"], "left")
    return out.withColumns({"enabled": F.coalesce("o_enabled", F.lit(True)), "description": F.coalesce("o_description", "description")}).drop("o_enabled", "o_description")


def tools_by_server(tools: DataFrame, overrides: DataFrame, size: int = 10_000) -> DataFrame:
    """``(server_name, slice, tools)``: each server's tools with their overrides, ordered by name.

    A server of more than ``size`` tools has several slices, dealt by name, so that no row and
    no task gathers more than about that many.
    """
    each = apply_overrides(tools, overrides)
    slices = each.groupBy("server_name").agg(F.ceil(F.count("*") / F.lit(float(size))).alias("_slices"))
    dealt = each.join(slices, "server_name").withColumn("slice", F.pmod(F.xxhash64("name"), F.col("_slices")).cast("int"))
    return dealt.groupBy("server_name", "slice").agg(F.sort_array(F.collect_list(F.struct("name", "enabled", "description"))).alias("tools"))


def shape_for_protocol(tools: DataFrame, version: str) -> DataFrame:
    """Tool rows as a protocol version knows them; the oldest lacks annotations and output schemas."""
    return tools.drop("annotations", "output_schema") if version == "2024-11-05" else tools


#: Protocol versions, the last is the default.
PROTOCOLS = ["2024-11-05", "2025-06-18", "2025-11-25", "2025-03-26"]


def negotiate(requested: Column) -> Column:
    """The requested version if known, else the default."""
    return F.when(requested.isin(PROTOCOLS), requested).otherwise(F.lit(PROTOCOLS[-1]))


def unknown_keys(entries: DataFrame, allowed: list[str], column: str = "entry") -> DataFrame:
    """Entries of maps with the keys that aren't allowed; those with any are skipped by an import."""
    return entries.withColumn("unknown", F.array_except(F.map_keys(column), F.array(*(F.lit(k) for k in allowed))))


def import_counts(entries: DataFrame, existing: DataFrame, key: str = "name") -> DataFrame:
    """How many entries an import takes and how many it skips as they exist."""
    marked = entries.join(existing.select(key).distinct().withColumn("known", F.lit(True)), key, "left")
    return marked.agg(F.count_if(F.col("known").isNull()).alias("imported"), F.count_if("known").alias("skipped"))
