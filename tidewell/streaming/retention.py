"""Retention of a stored table as a stream that ticks.

The job is a stream of ticks whose batches ask whether a run is due: the first one
tick after the start, the next ones ``every`` after the last. A run deletes the
rows older than so many days before the tick, so a batch that is run again after a
failure has the same limit, and its number is noted in the same change of the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewell import tables as store

RUNS = "retention_runs"


def clock(spark: SparkSession) -> DataFrame:
    """A stream of ticks, ``timestamp``; a trigger finds those since the last one."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load().select("timestamp")


def retention(tables: store.Tables, name: str, column: str, job: str, days: int = 15, every: str = "6 hours") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over ticks: deletes what is older than ``days`` where a run is due.

    ``job`` names the job in the table of runs. A batch without ticks does nothing.
    """

    def tick(batch: DataFrame, number: int) -> None:
        spark, run = batch.sparkSession, f"{job}/{number}"
        now = F.max("timestamp").cast("timestamp_ntz")
        # The limit is written down as it is compared: as a time without zone.
        at, cutoff = batch.agg(now.cast("string"), (now - F.expr(f"interval '{int(days)}' day")).cast("string")).first()
        if at is None:
            return
        held = tables.snapshot()
        if RUNS in held:
            last = held.read(RUNS).where(F.startswith("run", F.lit(f"{job}/"))).agg(F.max("cutoff")).first()[0]
            if last is not None and spark.range(1).where(F.lit(cutoff).cast("timestamp_ntz") < F.lit(last).cast("timestamp_ntz") + F.expr(f"interval {every}")).count():
                return
        store.retain(tables, name, column, cutoff, run, RUNS)

    return tick


def start_retention(
    ticks: DataFrame, tables: store.Tables, name: str, column: str, checkpoint: str, job: str = "retention", days: int = 15, every: str = "6 hours", interval: str | None = "5 minutes"
) -> DataStreamWriter:
    """Writer of the job, asking at an interval, or once over all ticks there are."""
    out = ticks.writeStream.foreachBatch(retention(tables, name, column, job, days, every)).option("checkpointLocation", checkpoint)
    return out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)
