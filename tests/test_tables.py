import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from tidewell.streaming import retention
from tidewell.tables import Conflict, Tables, retain

DAY0 = dt.datetime(2024, 1, 31)


@pytest.fixture()
def tables(spark, tmp_path):
    return Tables(spark, str(tmp_path / "base"))


def numbers(spark, a, b):
    return spark.range(a, b).withColumn("x", F.col("id") * 2)


def test_a_reader_beside_many_switches(spark, tables):
    """Two tables switch together fifty times; a reader never misses one, nor sees two of different changes."""
    tables.commit({"a": numbers(spark, 0, 3), "b": numbers(spark, 0, 3)}, tables.snapshot())
    stop, failed, seen = threading.Event(), [], set()

    def reads():
        while not stop.is_set():
            try:
                now = tables.snapshot()
                a, b = (now.read(n).agg(F.min("id"), F.count("*")).first() for n in "ab")
                assert a == b and a[1] == 3, (a, b)
                seen.add(a[0])
            except Exception as e:  # noqa: BLE001 - whatever it is, the test fails of it
                failed.append(e)

    reader = threading.Thread(target=reads)
    reader.start()
    for i in range(1, 51):
        tables.change(lambda now, i=i: {"a": numbers(spark, i, i + 3).coalesce(1), "b": numbers(spark, i, i + 3).coalesce(1)})
        if i % 10 == 0:
            tables.vacuum(keep=8, grace=5)
    stop.set()
    reader.join()
    assert not failed and len(seen) > 3
    assert tables.vacuum(keep=1, grace=0) > 0 and tables.snapshot().version == 51
    assert tables._names("manifests") == [f"{51:012d}.json"] and len(tables._names("data")) == 2
    assert tables.read("a").count() == 3


def test_of_two_writers_one_is_next(spark, tables):
    tables.commit({"a": numbers(spark, 0, 1)}, tables.snapshot())
    old = tables.snapshot()
    tables.append("a", numbers(spark, 1, 2))
    with pytest.raises(Conflict):
        tables.commit({"a": numbers(spark, 9, 10), "b": numbers(spark, 9, 10)}, old)
    assert sorted(r.id for r in tables.read("a").collect()) == [0, 1] and "b" not in tables.snapshot()
    asked = []

    def again(now):
        if not asked:
            tables.append("a", numbers(spark, 2, 3))
        asked.append(now.version)
        return {"a": now.read("a").where("id > 0")}

    tables.change(again)
    assert asked == [2, 3] and sorted(r.id for r in tables.read("a").collect()) == [1, 2]
    assert [r.id for r in old.read("a").collect()] == [0], "an old snapshot reads what it read"
    tables.change(lambda now: {"a": None})
    assert "a" not in tables.snapshot() and tables.read("a", old.schema("a")).count() == 0
    with pytest.raises(KeyError):
        tables.read("a")


def test_parts_have_the_tables_columns(spark, tables):
    tables.append("a", numbers(spark, 0, 2))
    with pytest.raises(ValueError, match="different columns"):
        tables.append("a", spark.range(3))
    tables.append("a", numbers(spark, 2, 4))
    assert tables.read("a").count() == 4 and tables.snapshot().version == 2
    tables.change(lambda now: {"a": spark.range(3)})  # a table may be replaced by one of other columns
    assert tables.read("a").columns == ["id"] and not any("schema" in p for p in tables.snapshot().parts("a"))


def test_compaction_goes_by_bytes(spark, tables):
    for i in range(6):
        tables.append("a", numbers(spark, 1000 * i, 1000 * i + 1000).repartition(4), "id")
    tables.append("a", numbers(spark, 10_000, 400_000).repartition(1))
    bytes_of = [tables.sizes(p) for p in tables.snapshot().parts("a")]
    small, large = sum(b for _, b in bytes_of[:6]), bytes_of[6]
    target = -(-small // 2)
    assert large[1] > target
    before = tables.read("a").agg(F.count("*"), F.sum("x")).first()
    assert tables.compact("a", target) == 22
    parts = tables.snapshot().parts("a")
    assert [tables.sizes(p)[0] for p in parts] == [1, 2] and (parts[1]["low"], parts[1]["high"], parts[1]["rows"]) == ("0", "5999", 6000)
    assert tables.read("a").agg(F.count("*"), F.sum("x")).first() == before
    assert tables.compact("a", target) == 0 and tables.compact("nothing") == 0


def log(spark, *days):
    rows = [(i, None if d is None else DAY0 - dt.timedelta(days=d)) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "id long, created_at timestamp_ntz").coalesce(1)


def test_retention_rewrites_only_what_the_limit_cuts(spark, tables):
    for days in ((40, 30), (16, 15, 14), (3, 1), (20, None)):
        tables.append("log", log(spark, *days), "created_at")
    paths = [p["path"] for p in tables.snapshot().parts("log")]
    cutoff = str(DAY0 - dt.timedelta(days=15))
    assert retain(tables, "log", "created_at", cutoff, "job/1") == (4, 5)
    after = [p["path"] for p in tables.snapshot().parts("log")]
    assert after[0] == paths[2] and len(after) == 2 and after[1] not in paths
    assert tables.read("log").where(F.col("created_at") < cutoff).count() == 0 and tables.read("log").where("created_at is null").count() == 1
    version = tables.snapshot().version
    assert retain(tables, "log", "created_at", "2030-01-01", "job/1") == (4, 5), "a run that is noted changes nothing"
    assert tables.snapshot().version == version
    assert retain(tables, "log", "created_at", cutoff, "job/2") == (0, 5) and retain(tables, "none", "created_at", cutoff) == (0, 0)
    assert sorted((r.run, r.deleted, r.kept) for r in tables.read("retention_runs").collect()) == [("job/1", 4, 5), ("job/2", 0, 5)]
    assert retain(tables, "log", "created_at", "2030-01-01") == (4, 1)


def test_retention_as_a_stream(spark, tables, tmp_path):
    """Old rows go within a trigger; a restart and a batch that runs again delete nothing twice."""
    tables.append("log", log(spark, 30, 16, 15.5, 14, 1), "created_at")
    source, checkpoint = str(tmp_path / "ticks"), str(tmp_path / "cp")
    schema = "timestamp timestamp"

    def tick(hours):
        at = (DAY0 + dt.timedelta(hours=hours)).isoformat(sep=" ")
        spark.createDataFrame([(at,)], "t string").select(F.col("t").cast("timestamp").alias("timestamp")).coalesce(1).write.mode("append").parquet(source)
        q = retention.start_retention(spark.readStream.schema(schema).parquet(source), tables, "log", "created_at", checkpoint, interval=None).start()
        q.awaitTermination(120)
        assert q.exception() is None
        runs = tables.read(retention.RUNS).orderBy("cutoff").collect()
        return [(r.deleted, r.kept) for r in runs], sorted(r.id for r in tables.read("log").collect())

    assert tick(0) == ([(3, 2)], [3, 4])
    tables.append("log", log(spark, 20), "created_at")
    assert tick(3) == ([(3, 2)], [0, 3, 4]), "the next run isn't due"
    assert tick(6) == ([(3, 2), (1, 2)], [3, 4])
    batch = spark.createDataFrame([((DAY0 + dt.timedelta(days=99)).isoformat(sep=" "),)], "t string").select(F.col("t").cast("timestamp").alias("timestamp"))
    retention.retention(tables, "log", "created_at", "retention")(batch, 2)
    assert tables.read("log").count() == 2, "batch 2 has run already"
    assert tick(48)[0][-1] == (1, 1)
    retention.retention(tables, "log", "created_at", "retention")(batch.where("false"), 9)
    assert tables.read(retention.RUNS).count() == 3


def test_the_clock_ticks(spark):
    assert retention.clock(spark).isStreaming and retention.clock(spark).columns == ["timestamp"]
