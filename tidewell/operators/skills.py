"""Skills and their exports to agents: joins, orphans, slugs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import slugify


def exports_with_skills(exports: DataFrame, skills: DataFrame) -> DataFrame:
    """Exports with the directory of their skill.

    Skills and listings grow with the catalog and their files are far smaller than their rows, so
    neither is held whole by a task as a file's size would suggest.
    """
    return exports.join(skills.select(F.col("id").alias("skill_id"), "dir_name").hint("merge"), "skill_id")


def orphan_exports(exports: DataFrame, skills: DataFrame) -> DataFrame:
    """Exports of skills that aren't there any more."""
    return exports.where("skill_id is not null").join(skills.select(F.col("id").alias("skill_id")), "skill_id", "left_anti")


def stale_exports(exports: DataFrame, skills: DataFrame, listing: DataFrame) -> DataFrame:
    """Exports whose directory isn't in the agent's listing ``(agent_id, dir_name)``."""
    return exports_with_skills(exports, skills).join(listing.hint("merge"), ["agent_id", "dir_name"], "left_anti")


def verified_exports(exports: DataFrame, skills: DataFrame, listing: DataFrame) -> DataFrame:
    """``(skill_id, agents)``: sorted agents whose listing holds the export."""
    there = exports_with_skills(exports, skills).join(listing.hint("merge"), ["agent_id", "dir_name"], "left_semi")
    return there.groupBy("skill_id").agg(F.array_join(F.array_sort(F.collect_set("agent_id")), ",").alias("agents"))


def export_plan(skill_ids: list[str], agent_ids: list[str], skills: DataFrame, agents: DataFrame) -> DataFrame:
    """Every chosen skill for every chosen agent; unknown ones drop out.

    Both lists come from one request and are as long as a person picks, so
    their product is made in one task's memory and joined by key.
    """
    spark = skills.sparkSession
    asked = spark.createDataFrame([(s,) for s in dict.fromkeys(skill_ids)], "skill_id string").withColumn("agent_id", F.explode(F.array(*(F.lit(a) for a in dict.fromkeys(agent_ids)))))
    return asked.join(skills.select(F.col("id").alias("skill_id"), "dir_name"), "skill_id").join(agents.select(F.col("id").alias("agent_id"), "path"), "agent_id")


def numbered_slugs(df: DataFrame, name: str = "name", order: str | None = None) -> DataFrame:
    """``slug`` of each row; the n-th of equal ones, by name or another column, gets ``-n``."""
    base = slugify(name)
    n = F.row_number().over(Window.partitionBy(base).orderBy(order or name))
    return df.withColumn("n", n).withColumn("slug", F.when(F.col("n") == 1, base).otherwise(F.concat(base, F.lit("-"), F.col("n").cast("string")))).drop("n")
