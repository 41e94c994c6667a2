"""Log fan-out: every micro-batch goes to a table and to text files."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tidewell.operators.activity import log_lines


def fan_out(table_path: str, file_path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows to Parquet, lines to text by day; a failed table doesn't stop the files.

    A batch is written under its number, so one that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            try:
                batch.write.mode("overwrite").parquet(f"{table_path}/batch={number}")
            except Exception:
                logging.getLogger(__name__).exception("log table of batch %s", number)
            log_lines(batch).write.mode("overwrite").partitionBy("day").text(f"{file_path}/batch={number}")
        finally:
            batch.unpersist()

    return write


def start_fan_out(stream: DataFrame, table_path: str, file_path: str, checkpoint: str, interval: str | None = None) -> DataStreamWriter:
    """Writer of the fan-out, polling at an interval or once over all there is."""
    out = stream.writeStream.foreachBatch(fan_out(table_path, file_path)).option("checkpointLocation", checkpoint)
    return out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)
