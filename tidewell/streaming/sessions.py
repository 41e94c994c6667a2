"""Idle sessions: a key's use ends when nothing happens for longer than the gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def idle_sessions(events: DataFrame, key: str, at: str, gap_ms: int = 300_000) -> DataFrame:
    """``(key, started, ended, n_events)``.

    An event exactly one gap after the last still belongs to its session, as
    the timer only fires when it finds no newer use. ``session_window`` merges
    at that very distance, so it says the same.
    """
    window = F.session_window(at, f"{gap_ms} milliseconds")
    return events.groupBy(key, window).agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n_events")).drop("session_window")


def stream_idle_sessions(events: DataFrame, key: str, at: str, gap_ms: int = 300_000, late: str = "10 minutes") -> DataFrame:
    """The same over a stream; a session is given out once the watermark has passed its end."""
    timed = events.withColumn("event_time", F.col(at).cast("timestamp")).withWatermark("event_time", late)
    window = F.session_window("event_time", f"{gap_ms} milliseconds").alias("w")
    return timed.groupBy(key, window).agg(F.min("event_time").alias("started"), F.max("event_time").alias("ended"), F.count("*").alias("n_events")).select(key, "started", "ended", "n_events")


def tumbling_counts(events: DataFrame, at: str, width: str, late: str, *keys: str) -> DataFrame:
    """Events of fixed windows; an addition of this engine for watching streams."""
    timed = events.withColumn("event_time", F.col(at).cast("timestamp")).withWatermark("event_time", late)
    return timed.groupBy(F.window("event_time", width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
