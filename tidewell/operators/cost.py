"""Context cost of tools, servers and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.numbers import token_estimate


def tool_costs(tools: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``(server_name, name, cost, enabled)``: the raw description and the schema, a token per 4 bytes.

    An override can turn a tool off; its description doesn't change the cost.
    """
    out = tools.select("server_name", "name", (token_estimate("description") + token_estimate("input_schema")).alias("cost"))
    if overrides is None:
        return out.withColumn("enabled", F.lit(True))
    own = overrides.where(F.col("item_type") == "tool").select("server_name", F.col("item_name").alias("name"), "enabled")
    return out.join(own, ["server_name", "name"], "left").withColumn("enabled", F.coalesce("enabled", F.lit(True)))


def server_costs(costs: DataFrame, servers: DataFrame | None = None) -> DataFrame:
    """``(name, exposed, gross)`` of each server; with ``servers``, also those without tools."""
    out = costs.groupBy(F.col("server_name").alias("name")).agg(
        F.sum(F.when(F.col("enabled"), F.col("cost")).otherwise(0)).alias("exposed"), F.sum("cost").alias("gross")
    )
    if servers is None:
        return out
    zero = F.lit(0).cast("bigint")
    return servers.join(out, "name", "left").withColumns({"exposed": F.coalesce("exposed", zero), "gross": F.coalesce("gross", zero)})


def group_costs(groups: DataFrame, costs: DataFrame) -> DataFrame:
    """``(name, server_count, exposed, gross)`` of groups ``(name, servers array)``.

    Unknown servers count as members, servers listed twice count twice.
    """
    zero = F.lit(0).cast("bigint")
    member = groups.select("name", F.explode_outer("servers").alias("server"))
    sums = costs.select(F.col("name").alias("server"), "exposed", "gross")
    return member.join(sums, "server", "left").groupBy("name").agg(
        F.count("server").alias("server_count"), F.coalesce(F.sum("exposed"), zero).alias("exposed"), F.coalesce(F.sum("gross"), zero).alias("gross")
    )


def footprint(costs: DataFrame) -> DataFrame:
    """Exposed cost of all connected servers."""
    return costs.where("connected").agg(F.coalesce(F.sum("exposed"), F.lit(0).cast("bigint")).alias("footprint"))


def selected_cost(costs: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """Cost of chosen items."""
    return costs.join(selected.select(*keys).distinct(), keys, "left_semi").agg(F.coalesce(F.sum("cost"), F.lit(0).cast("bigint")).alias("cost"))
