"""Versions: latest of each major, newest of each branch, update states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.numbers import is_newer, version_parts


def newest_first(rows: DataFrame, version: str = "version", key: str = "id") -> DataFrame:
    """All rows, the highest version first; equal ones by key."""
    return rows.orderBy(version_parts(version).desc(), key)


def latest_per_major(releases: DataFrame, n: int = 10) -> DataFrame:
    """Latest version of the ``n`` newest majors of ``(version, lts)``; only long-term ones, ``x.y.z``."""
    v = F.regexp_replace("version", "^v+", "")
    part = lambda i: F.split_part(v, F.lit("."), F.lit(i)).try_cast("bigint")
    ok = releases.where(F.col("lts") & v.rlike(r"^\d+\.\d+\.\d+$")).select(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), v.alias("version"))
    return ok.groupBy("major").agg(F.max_by("version", F.struct("minor", "patch")).alias("version")).orderBy(F.desc("major")).limit(n)


def newest_of_branches(cycles: DataFrame, branches: tuple[int, ...] = (3, 2), n: int = 10) -> DataFrame:
    """The ``n`` highest minors of each branch of ``(cycle, latest)``."""
    part = lambda i: F.get(F.split("cycle", r"\."), F.lit(i)).try_cast("bigint")
    ok = cycles.where("latest is not null").select(part(0).alias("major"), part(1).alias("minor"), "latest").where(F.col("major").isin(*branches) & F.col("minor").isNotNull())
    w = Window.partitionBy("major").orderBy(F.desc("minor"), F.desc("latest"))
    return ok.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def update_states(checks: DataFrame) -> DataFrame:
    """Of each package's checks ``(package, at, version)``: first seen is recorded,
    a newer one than the last is flagged, any other clears the flag."""
    w = Window.partitionBy("package").orderBy("at", "version")
    before = F.lag("version").over(w)
    return checks.withColumn("before", before).withColumn(
        "state", F.when(F.col("before").isNull(), "recorded").when(is_newer("version", "before"), "newer").otherwise("clear")
    )
