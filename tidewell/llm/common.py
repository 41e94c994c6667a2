"""Helpers that several operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewell.shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts lineage.

    The files outlive any executor, so a lost one costs only its running tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches, rows: int = 1024, size: int = 8 << 20):
    """The same rows in smaller batches, of so many rows and, but for a single row, bytes of text."""
    for batch in batches:
        held = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
                held += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(held), 0
        while at < batch.num_rows:
            fits = int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right"))
            end = min(at + rows, max(at + 1, fits), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def map_columns(
    df: DataFrame, columns: list[str], schema: str, fn: Callable[..., dict]
) -> DataFrame:
    """Run ``fn(*lists) -> {column: values}`` over Arrow batches of ``columns``."""
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches):
        for batch in slices(batches):
            out = fn(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))
            yield pa.RecordBatch.from_pydict({f.name: pa.array(out[f.name], type=f.type) for f in arrow}, schema=arrow)

    return df.select(*columns).mapInArrow(run, struct)


def connected_components(edges: DataFrame, tag: str = "components", max_rounds: int = 64) -> DataFrame:
    """Smallest reachable node of each node with an edge: ``(node, component)``.

    ``edges`` has the long columns ``a`` and ``b``. Alternates large-star and
    small-star rounds (Kiveris et al., "Connected Components in MapReduce and
    Beyond", 2014) until nothing moves; every round is a join and a grouping
    with partial minima, so no node's neighbours are gathered in one place.
    """
    e = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{tag}-0",
    )
    seen = None
    for i in range(1, max_rounds + 1):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
            .where("x.v <> x.m")
            .select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
            .distinct()
        )
        e = materialize(small, f"{tag}-{i}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def filter_texts(df: DataFrame, make_keep: Callable[[], Callable], column: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose text ``make_keep()`` says to keep.

    ``make_keep`` runs once a task; what it returns gets one whole text, however long, or None. Rows are
    judged one by one, so repeated rows and ids play no part; an empty table stays empty.
    """

    def run(batches):
        keep = make_keep()
        for batch in slices(batches):
            at = batch.schema.get_field_index(column)
            yield batch.filter(pa.array([bool(keep(t)) for t in batch.column(at).to_pylist()], type=pa.bool_()))

    return df.mapInArrow(run, df.schema)
