"""Tasks: a state machine that ends once, and their expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TERMINAL = ("completed", "failed", "cancelled")


def final_states(changes: DataFrame, key: str, order: str) -> DataFrame:
    """``(key, status)``: the first terminal state of each task; later results are dropped."""
    end = F.col("status").isin(*TERMINAL)
    return changes.groupBy(key).agg(F.coalesce(F.min_by(F.when(end, F.col("status")), F.when(end, F.col(order))), F.lit("working")).alias("status"))


class TaskMachine(StatefulProcessor):
    """Keeps a task's state until its time to live, or five minutes after its end, is over, whichever is first.

    Gives out every change that takes effect, and ``expired`` when the state is dropped. A task ends
    once: states after the first terminal one change nothing, also late ones that are older. The time at which
    the state is due is part of it and has the task's only timer; a new due time deletes the timer before, and one
    that fires for another time is ignored, so a later task of the same id has its full time.
    """

    def __init__(self, ttl_ms: int = 3_600_000, keep_ms: int = 300_000, event_time: bool = False):
        self.ttl_ms, self.keep_ms, self.event_time = ttl_ms, keep_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, due = self.state.get() if self.state.exists() else (None, None)
        now, before, out = timerValues.getCurrentProcessingTimeInMs(), due, []
        # A batch's rows of a task come in parts that need not follow each other in time.
        changes = pd.concat([part[["at", "status"]] for part in rows], ignore_index=True).dropna(subset=["status"]).sort_values("at", kind="stable")
        for at, new in zip(changes["at"], changes["status"], strict=True):
            if status in TERMINAL or new == status:
                continue
            since = int(pd.Timestamp(at).value // 1_000_000) if self.event_time and at is not pd.NaT else now
            if status is None:
                due = since + self.ttl_ms
            if new in TERMINAL:
                due = min(due, since + self.keep_ms)
            status = new
            out.append(new)
        if status is not None and due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
            self.state.update((status, due))
        elif out:
            self.state.update((status, due))
        yield pd.DataFrame({"task_id": [key[0]] * len(out), "status": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803  called by these names
        if self.state.exists() and self.state.get()[1] == expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield pd.DataFrame({"task_id": [key[0]], "status": ["expired"]})

    def close(self) -> None:
        pass


def stream_tasks(changes: DataFrame, ttl_ms: int = 3_600_000, keep_ms: int = 300_000, late: str | None = None) -> DataFrame:
    """Changes ``(task_id, at, status)`` of a stream that take effect.

    Times count by the clock or, where ``late`` says how late a change may come, by ``at``.
    """
    rows = changes.select("task_id", F.col("at").cast("timestamp").alias("at"), "status")
    if late is not None:
        rows = rows.withWatermark("at", late)
    return rows.groupBy("task_id").transformWithStateInPandas(
        TaskMachine(ttl_ms, keep_ms, late is not None), outputStructType="task_id string, status string", outputMode="Append", timeMode="ProcessingTime" if late is None else "EventTime"
    )


def stream_first_terminal(changes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """First terminal state of each task by event time, without Python state: repeats within the watermark drop out."""
    timed = changes.withColumn("event_time", F.col("at").cast("timestamp")).withWatermark("event_time", late)
    return timed.where(F.col("status").isin(*TERMINAL)).dropDuplicatesWithinWatermark(["task_id"]).select("task_id", "status", "event_time")
