"""Access scopes: which servers and tools a caller sees, and where a call goes.

Scopes and keys are small tables of settings, tools may be many; every step is
a join on names, no list is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.catalog import apply_overrides, shape_for_protocol


def server_names(servers: Column) -> Column:
    """Names in a variant array whose elements are strings or objects with a name; others drop out."""
    each = F.from_json(servers, "array<string>")
    return F.filter(F.transform(each, lambda s: F.coalesce(F.get_json_object(s, "$.name"), F.when(~s.startswith("{") & ~s.startswith("["), s))), lambda s: s.isNotNull())


def selection(value: Column) -> Column:
    """A filter list in JSON as names; ``"all"``, nothing, or an empty list mean no restriction (null)."""
    names = F.from_json(value, "array<string>")
    return F.when(value.startswith("[") & (F.size(names) > 0), names)


def allowed_servers(keys: DataFrame, groups: DataFrame) -> DataFrame:
    """``(key_id, server)`` of keys restricted to servers, groups or both.

    Keys of other access types have no rows: nothing restricts them.
    ``keys`` (id, access_type, allowed_groups, allowed_servers), ``groups`` (name, servers).
    """
    direct = keys.where(F.col("access_type").isin("servers", "custom")).select(F.col("id").alias("key_id"), F.explode("allowed_servers").alias("server"))
    wanted = keys.where(F.col("access_type").isin("groups", "custom")).select(F.col("id").alias("key_id"), F.explode("allowed_groups").alias("name"))
    member = groups.select("name", F.explode("servers").alias("server"))
    return direct.unionByName(wanted.join(member, "name").select("key_id", "server")).distinct()


def restrict(filters: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Servers in scope that a key may use; no table, no restriction."""
    return filters if allowed is None else filters.join(allowed.select(F.col("server").alias("name")).distinct(), "name", "left_semi")


def scope_servers(scope: str, statuses: DataFrame, groups: DataFrame, builtin: str | None = None) -> DataFrame:
    """``(name, tools, ord)`` of a scope, ``tools`` null where all are allowed.

    ``statuses`` (name, connected, start_on_demand, ord), ``groups`` (id, name,
    members array of (name, tools)). An empty scope or ``$smart`` is everything
    that runs or can be started, and the builtin; else a group by name or id,
    else the builtin, else one server.
    """
    s = scope.lstrip("/").strip()
    live = statuses.where(F.coalesce(F.col("connected"), F.lit(False)) | F.coalesce(F.col("start_on_demand"), F.lit(False)))
    every = F.lit(None).cast("array<string>")
    plain = live.select("name", every.alias("tools"), F.col("ord").cast("bigint").alias("ord"))
    spark = statuses.sparkSession
    own = spark.range(1).select(F.lit(builtin).cast("string").alias("name"), every.alias("tools"), F.lit(1 << 62).cast("bigint").alias("ord")).where("name is not null")
    if s in ("", "$smart"):
        return plain.unionByName(own)
    name = s.removeprefix("$smart/")
    group = groups.where((F.col("name") == name) | (F.col("id") == name)).orderBy("name", "id").limit(1)
    member = group.select(F.posexplode("members").alias("ord", "m")).select(
        "m.name", F.when(F.size("m.tools") > 0, F.col("m.tools")).alias("tools"), F.col("ord").cast("bigint").alias("ord")
    )
    if not group.isEmpty():  # a lookup by name of one row
        return member
    return own.where(F.col("name") == name) if builtin == name else plain.where(F.col("name") == name)


def listed_tools(filters: DataFrame, tools: DataFrame, separator: str = "-") -> DataFrame:
    """``(server_name, name, exposed_name, description)`` of the enabled, allowed tools.

    With more than one server in scope the server's name is put before.
    """
    many = filters.limit(2).count() > 1
    out = filters.select(F.col("name").alias("server_name"), F.col("tools").alias("allowed"), "ord").join(tools.where("enabled"), "server_name")
    out = out.where(F.col("allowed").isNull() | F.array_contains("allowed", F.col("name")))
    exposed = F.concat("server_name", F.lit(separator), "name") if many else F.col("name")
    return out.select("server_name", "name", exposed.alias("exposed_name"), F.coalesce("description", F.lit("")).alias("description"))


def tools_list(
    filters: DataFrame, tools: DataFrame, allowed: DataFrame | None = None, overrides: DataFrame | None = None, version: str = "2025-06-18", separator: str = "-"
) -> DataFrame:
    """What a caller is shown of its scope, one row a tool.

    The servers in scope that its key may use, the tools as their overrides say,
    switched on and allowed by the group, named with the server before where
    there are several, in the form that the protocol version knows. ``tools``
    (server_name, name, description, enabled, and as far as there are,
    input_schema, annotations, output_schema).
    """
    filters = restrict(filters, allowed)
    if overrides is not None:
        tools = apply_overrides(tools, overrides)
    more = [c for c in ("input_schema", "annotations", "output_schema") if c in tools.columns]
    shown = listed_tools(filters, tools, separator).join(tools.select("server_name", "name", *more), ["server_name", "name"]) if more else listed_tools(filters, tools, separator)
    return shape_for_protocol(shown, version)


def servers_of_groups(groups: DataFrame) -> DataFrame:
    """``(name, server)`` of each group ``(name, servers)`` and member, each once."""
    return groups.select("name", F.explode("servers").alias("server")).distinct()


def route(calls: DataFrame, filters: DataFrame, tools: DataFrame, separator: str = "-") -> DataFrame:
    """``(call_id, tool_name, server_name, name)``: where each call goes, null if nowhere.

    With several servers, the first in scope order whose prefixed tool has the
    called name; else the first that has a tool of that very name. The exposed
    name is a key of the join, so no prefix is compared with every server.
    """
    many = filters.limit(2).count() > 1
    there = filters.select(F.col("name").alias("server_name"), F.col("tools").alias("allowed"), "ord").join(tools.select("server_name", "name").distinct(), "server_name")
    there = there.where(F.col("allowed").isNull() | F.array_contains("allowed", F.col("name")))
    prefixed = [F.struct(F.concat("server_name", F.lit(separator), "name").alias("tool_name"), F.lit(0).alias("pass"))] * many
    names = F.array(F.struct(F.col("name").alias("tool_name"), F.lit(1).alias("pass")), *prefixed)
    ways = there.select("server_name", "name", "ord", F.explode(names).alias("x")).select("server_name", "name", "ord", "x.tool_name", "x.pass")
    best = ways.groupBy("tool_name").agg(F.min_by(F.struct("server_name", "name"), F.struct("pass", "ord", "server_name")).alias("to"))
    return calls.join(best, "tool_name", "left").select("call_id", "tool_name", F.col("to.server_name").alias("server_name"), F.col("to.name").alias("name"))


def builtin_items(items: DataFrame, selected: list[str] | None, key: str = "name") -> DataFrame:
    """Enabled prompts or resources that a selection allows; none means all."""
    out = items.where("enabled")
    return out if selected is None else out.where(F.col(key).isin(selected))


def group_tally(groups: DataFrame, tools: DataFrame) -> DataFrame:
    """``(name, visible, total)`` tools of each group ``(name, members)``."""
    member = groups.select(F.col("name").alias("group_name"), F.explode("members").alias("m")).select("group_name", F.col("m.name").alias("server_name"), F.col("m.tools").alias("allowed"))
    seen = F.col("enabled") & (F.col("allowed").isNull() | F.array_contains("allowed", F.col("name")))
    return member.join(tools, "server_name").groupBy(F.col("group_name").alias("name")).agg(F.count_if(seen).alias("visible"), F.count("*").alias("total"))
