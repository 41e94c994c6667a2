"""Activity and application logs: filters, statistics, pages, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.numbers import days_before
from tidewell.functions.text import like_ascii, log_line


def activity_filter(server=None, status: str | None = None, tool: str | None = None, **more) -> Column:
    """All given filters together; one that is absent adds nothing.

    ``more`` are equalities on other columns, such as ``group_name`` or
    ``key_name``, and ``since`` / ``until`` on ``created_at``.
    """
    parts = [F.col(c) == v for c, v in (("server", server), ("status", status)) if v is not None]
    if tool is not None:
        parts.append(like_ascii("tool", tool))
    if (since := more.pop("since", None)) is not None:
        parts.append(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    if (until := more.pop("until", None)) is not None:
        parts.append(F.col("created_at") < F.lit(until).cast("timestamp_ntz"))
    parts += [F.col(c) == v for c, v in more.items() if v is not None]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def activity_stats(log: DataFrame, where: Column | None = None) -> DataFrame:
    """``(total, success, errors, avg_duration)``; zeros of an empty log; null durations don't count."""
    count = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, 1).otherwise(0)), F.lit(0)).cast("bigint")
    return log.where(F.lit(True) if where is None else where).agg(
        F.count("*").alias("total"), count("success").alias("success"), count("error").alias("errors"),
        F.round(F.coalesce(F.avg("duration_ms"), F.lit(0.0)), 6).alias("avg_duration"),
    )


def page_bounds(page: int | None, size: int | None, default: int, most: int = 200) -> tuple[int, int]:
    """Offset and limit of a page; pages begin at 1, sizes are clamped."""
    n = min(max(default if size is None else size, 1), most)
    return (max(page or 1, 1) - 1) * n, n


def newest_page(log: DataFrame, page: int | None = None, size: int | None = None, default: int = 20, key: str = "id", where: Column | None = None) -> DataFrame:
    """A page by falling time, ties by the key."""
    skip, n = page_bounds(page, size, default)
    return rows_at(log.where(F.lit(True) if where is None else where), ["-created_at", f"-{key}"], skip, n)


def after_cursor(df: DataFrame, key: str, cursor, n: int) -> DataFrame:
    """The next rows after a key; the key is pushed to the scan."""
    return (df if cursor is None else df.where(F.col(key) > F.lit(cursor))).orderBy(key).limit(n)


def _stands(order: list[str], edge: tuple) -> tuple[Column, Column]:
    """Whether a row stands after an edge in the order, and whether at it; nulls are first, or last where it falls."""
    after, same = F.lit(False), F.lit(True)
    for name, value in zip(order, edge, strict=True):
        c, falls = F.col(name.removeprefix("-")), name.startswith("-")
        if value is None:
            later = F.lit(False) if falls else c.isNotNull()
        else:
            later = c.isNull() | (c < F.lit(value)) if falls else c.isNotNull() & (c > F.lit(value))
        after = after | (same & later)
        same = same & c.eqNullSafe(F.lit(value))
    return after, same


def _sorted(df: DataFrame, order: list[str]) -> DataFrame:
    return df.orderBy(*(F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order))


def rows_at(df: DataFrame, order: list[str], skip: int, n: int, most: int = 20_000, ranges: int = 16) -> DataFrame:
    """``n`` rows from the place ``skip`` on, by ``order``; a column with ``-`` falls.

    While the place is beyond ``most`` the rows are counted by ranges: edges come from a
    sample by hash, each range's rows are counted in one pass, and only those that hold the page stay, by a
    filter between two edges. So no task sorts or holds more than one range and the page, however deep
    it is. The order should end in a key: rows that are equal in it can't be parted by ranges.
    """
    names = [c.removeprefix("-") for c in order]
    total = None
    while skip > most:
        total = df.count() if total is None else total
        if skip >= total:
            return df.limit(0)
        step = max(1, total // (ranges * 32))
        sample = _sorted(df.select(*names).where(F.pmod(F.xxhash64(*names), F.lit(step)) == 0).distinct(), order).collect()
        edges = [tuple(r) for r in sample[:: max(1, len(sample) // ranges)]]
        # The first edge that a row stands before: one flat CASE, however many edges there are.
        place = F
        for i, (after, same) in enumerate(_stands(order, e) for e in edges):
            place = place.when(~(after | same), i)
        place = F.lit(0) if place is F else place.otherwise(len(edges))
        counts = dict(df.groupBy(place.alias("r")).count().collect())
        first, before = 0, 0
        while before + counts.get(first, 0) <= skip:
            before += counts.get(first, 0)
            first += 1
        last, until = first, before + counts.get(first, 0)
        while until < min(skip + n, total):
            last += 1
            until += counts.get(last, 0)
        if until - before >= total:
            break  # one range holds all: equal rows
        if first > 0:
            after, same = _stands(order, edges[first - 1])
            df = df.where(after | same)
        if last < len(edges):
            after, same = _stands(order, edges[last])
            df = df.where(~(after | same))
        total, skip = until - before, skip - before
    return _sorted(df, order).offset(skip).limit(n)


def clamped_page(df: DataFrame, order: list[str], page: int, size: int, empty_pages: int = 1) -> DataFrame:
    """Rows of a page whose number is clamped to those there are, with the page's facts.

    The rows are counted first, so the page is a limit of its own, not a rank over all.
    """
    total = df.count()
    pages = max(empty_pages, -(-total // size))
    at = min(max(1, page), max(pages, 1))
    return rows_at(df, order, (at - 1) * size, size).select(
        "*", F.lit(at).alias("page"), F.lit(total).cast("bigint").alias("total"), F.lit(pages).alias("total_pages"),
        F.lit(at < pages).alias("has_next"), F.lit(at > 1).alias("has_prev"),
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Non-empty values, once each, ordered."""
    return df.where(F.col(column) != "").select(column).distinct().orderBy(column)


def retain(log: DataFrame, now: str, days: int = 15) -> DataFrame:
    """Rows that a retention of so many days keeps; null times stay."""
    return log.where(F.coalesce(F.col("created_at") >= days_before(now, days), F.lit(True)))


def retention_counts(log: DataFrame, now: str, days: int = 15) -> DataFrame:
    gone = F.coalesce(F.col("created_at") < days_before(now, days), F.lit(False))
    return log.agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept"))


def retain_day_files(files: DataFrame, first_day: str, column: str = "path") -> DataFrame:
    """Files named ``...-YYYY-MM-DD.log`` from a day on; others stay."""
    day = F.nullif(F.regexp_extract(column, r"(\d{4}-\d{2}-\d{2})\.log$", 1), F.lit(""))
    return files.where(F.coalesce(day >= first_day, F.lit(True)))


def without_payload(log: DataFrame, keep: bool, columns: tuple[str, ...] = ("input", "output")) -> DataFrame:
    """Tool payloads as null unless they are to be kept."""
    return log.withColumns({c: F.when(F.lit(keep), F.col(c)) for c in columns})


def log_lines(log: DataFrame) -> DataFrame:
    """``(day, line)`` for a text sink partitioned by day."""
    return log.select(F.date_format("created_at", "yyyy-MM-dd").alias("day"), log_line(F.col("created_at"), F.col("level"), F.col("server_name"), F.col("message")).alias("line"))


def view_filter(log: DataFrame, text: str = "", levels: list[str] | None = None, sources: list[str] | None = None) -> DataFrame:
    """Lines with a text, of one of the levels and, if any are named, sources."""
    out = log.where(F.contains(F.lower("message"), F.lit(text.lower())))
    if levels is not None:
        out = out.where(F.col("level").isin(levels))
    return out.where(F.col("source").isin(sources)) if sources else out


def tail(log: DataFrame, n: int, group: list[str], order: list[str]) -> DataFrame:
    """Last ``n`` rows of each group; each task keeps no more than that of a group."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy(*(F.desc(c) for c in order))
    return log.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")
