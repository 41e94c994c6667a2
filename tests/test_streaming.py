import datetime as dt
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewell.operators import activity, scope
from tidewell.streaming import logs, sessions, tasks

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def stream(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def drain(df, name, checkpoint):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_sessions_at_the_gap(spark):
    e = spark.createDataFrame([("k", at(0)), ("k", at(300)), ("k", at(601)), ("j", at(0))], "k string, ts timestamp_ntz")
    got = sorted((r.k, r.n_events) for r in sessions.idle_sessions(e, "k", "ts").collect())
    assert got == [("j", 1), ("k", 1), ("k", 2)]


def test_streamed_sessions_wait_for_the_watermark(spark, tmp_path):
    rows = [("k", at(0)), ("k", at(10)), ("k", at(7200)), ("j", at(20))]
    df = stream(spark, rows, "k string, ts timestamp_ntz", str(tmp_path / "in"))
    got = drain(sessions.stream_idle_sessions(df, "k", "ts"), "sessions", str(tmp_path / "cp"))
    assert sorted((r.k, r.n_events) for r in got) == [("j", 1), ("k", 2)]


def test_tumbling_counts(spark, tmp_path):
    df = stream(spark, [("k", at(1)), ("k", at(2)), ("k", at(9000))], "k string, ts timestamp_ntz", str(tmp_path / "in"))
    got = drain(sessions.tumbling_counts(df, "ts", "1 minute", "1 minute", "k"), "tumbling", str(tmp_path / "cp"))
    assert [r.n for r in got] == [2]


def test_final_states(spark):
    rows = [("a", 1, "working"), ("a", 3, "failed"), ("a", 2, "completed"), ("b", 1, "working")]
    df = spark.createDataFrame(rows, "task_id string, at long, status string")
    assert {r.task_id: r.status for r in tasks.final_states(df, "task_id", "at").collect()} == {"a": "completed", "b": "working"}


def test_first_terminal_of_a_stream(spark, tmp_path):
    rows = [("a", at(1), "working"), ("a", at(2), "completed"), ("a", at(3), "failed"), ("b", at(1), "cancelled")]
    df = stream(spark, rows, "task_id string, at timestamp_ntz, status string", str(tmp_path / "in"))
    got = drain(tasks.stream_first_terminal(df), "terminal", str(tmp_path / "cp"))
    assert sorted(r.task_id for r in got) == ["a", "b"]


def test_log_fan_out(spark, tmp_path):
    rows = [(1, "info", "m", None, at(0)), (2, "warn", "n", "s", at(1))]
    df = stream(spark, rows, "id long, level string, message string, server_name string, created_at timestamp_ntz", str(tmp_path / "in"))
    q = logs.start_fan_out(df, str(tmp_path / "t"), str(tmp_path / "f"), str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    lines = {r.value for r in spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "f")).collect()}
    assert lines == {"[2024-01-01 00:00:00] [info] m", "[2024-01-01 00:00:01] [warn] [s] n"}


def test_pages_and_retention(spark):
    log = spark.createDataFrame([(i, at(i // 2)) for i in range(10)], "id long, created_at timestamp_ntz")
    assert [r.id for r in activity.newest_page(log, 0, 3).collect()] == [9, 8, 7]
    assert activity.page_bounds(1, 500, 20) == (0, 200) and activity.page_bounds(3, None, 20) == (40, 20)
    empty = log.where("id < 0")
    assert activity.clamped_page(empty, ["id"], 5, 10).count() == 0
    assert activity.retention_counts(log.withColumn("created_at", F.lit(None).cast("timestamp_ntz")), "2024-01-31 00:00:00").first().kept == 10


def test_deep_pages_by_ranges(spark):
    """Pages anywhere equal those of an offset: falling and rising columns, nulls, ties, strings, one value for a third of the rows."""
    rows = [(i, None if i % 7 == 0 else (i * 37) % 101, "x" if i % 3 == 0 else f"s{i % 50}", None if i % 11 == 0 else at(i % 40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, n int, s string, created_at timestamp_ntz").repartition(4)
    for order in (["-n", "id"], ["n", "-s", "id"], ["-created_at", "-id"], ["s", "-created_at", "id"]):
        plain = df.orderBy(*(F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in order)).collect()
        for skip, n in ((0, 5), (50, 20), (999, 40), (1500, 1), (2980, 50), (2999, 1), (3000, 5), (9999, 5)):
            assert activity.rows_at(df, order, skip, n, most=60, ranges=8).collect() == plain[skip : skip + n], (order, skip)
    same = df.select(F.lit(1).alias("k"))
    assert activity.rows_at(same, ["k"], 2000, 5, most=60, ranges=8).count() == 5
    assert activity.rows_at(df.where("false"), ["id"], 100, 5, most=60).count() == 0
    assert activity.newest_page(df, 3, 10).collect() == activity.rows_at(df, ["-created_at", "-id"], 20, 10, most=3).collect()


def test_a_deep_page_sorts_one_range(spark):
    df = spark.range(100_000)
    page = activity.rows_at(df, ["-id"], 99_000, 10, most=1000)
    assert [r.id for r in page.collect()] == list(range(999, 989, -1))
    from pyspark.sql import DataFrame

    limits = [int(x) for x in __import__("re").findall(r"TakeOrderedAndProject\(limit=(\d+)", page._jdf.queryExecution().executedPlan().toString())]
    assert isinstance(page, DataFrame) and limits and max(limits) < 4000


def test_routing_prefers_prefix_then_order(spark):
    filters = spark.createDataFrame([("a", None, 0), ("a-b", None, 1)], "name string, tools array<string>, ord long")
    tools = spark.createDataFrame([("a", "b-c"), ("a-b", "c"), ("a-b", "d")], "server_name string, name string")
    calls = spark.createDataFrame([(1, "a-b-c"), (2, "d"), (3, "zz")], "call_id long, tool_name string")
    got = {r.call_id: (r.server_name, r.name) for r in scope.route(calls, filters, tools).collect()}
    assert got == {1: ("a", "b-c"), 2: ("a-b", "d"), 3: (None, None)}
    one = filters.where("name = 'a-b'")
    assert {r.call_id: r.server_name for r in scope.route(calls, one, tools).collect()} == {1: None, 2: "a-b", 3: None}


def test_empty_tool_list_means_all(spark):
    n = spark.createDataFrame([('"all"',), ("[]",), ('["x"]',), (None,)], "v string")
    assert [r[0] for r in n.select(scope.selection(F.col("v"))).collect()] == [None, None, ["x"], None]


def test_task_machine_over_a_stream(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rows = [("a", at(1), "working"), ("a", at(2), "completed"), ("a", at(3), "failed"), ("b", at(1), "working"), ("b", at(2), "working")]
    df = stream(spark, rows, "task_id string, at timestamp_ntz, status string", str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        # By the clock there is always a next batch that looks at timers, so the query is stopped once its rows are there.
        q = tasks.stream_tasks(df).writeStream.format("memory").queryName("machine").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
        until = time.time() + 120
        while time.time() < until and spark.table("machine").count() < 3:
            time.sleep(0.5)
        q.stop()
        got = spark.table("machine").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted((r.task_id, r.status) for r in got) == [("a", "completed"), ("a", "working"), ("b", "working")]


class _Timers:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now

    getExpiryTimeInMs = getCurrentProcessingTimeInMs  # noqa: N815


class _Handle:
    """State and timers of one key, as the engine keeps them, with its clock in the test's hands."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


def machine(**options):
    import pandas as pd

    m, handle = tasks.TaskMachine(**options), _Handle()
    m.init(handle)

    def take(now, *parts):
        frames = [pd.DataFrame({"at": pd.to_datetime([p[0] for p in part], unit="s"), "status": [p[1] for p in part]}) for part in parts]
        return [s for f in m.handleInputRows(("a",), iter(frames), _Timers(now)) for s in f["status"]]

    def pass_time(now):
        fired = [t for t in sorted(handle.timers) if t <= now]
        handle.timers = [t for t in handle.timers if t > now]
        return [s for t in fired for f in m.handleExpiredTimer(key=("a",), timerValues=None, expiredTimerInfo=_Timers(t)) for s in f["status"]]

    return handle, take, pass_time


def test_an_id_used_again_has_its_full_time():
    handle, take, pass_time = machine(ttl_ms=1000, keep_ms=100)
    assert take(0, [(1, "working")]) == ["working"] and handle.timers == [1000]
    assert take(50, [(2, "completed")]) == ["completed"] and handle.timers == [150], "the first timer is deleted"
    assert pass_time(149) == [] and pass_time(150) == ["expired"] and handle.timers == []
    assert take(900, [(3, "working")]) == ["working"] and handle.timers == [1900]
    assert pass_time(1000) == [] and handle.value == ("working", 1900), "nothing of the task before kills this one"
    assert pass_time(1900) == ["expired"]


def test_time_to_live_comes_before_a_late_end():
    handle, take, pass_time = machine(ttl_ms=1000, keep_ms=500)
    take(0, [(1, "working")])
    assert take(900, [(2, "failed")]) == ["failed"] and handle.timers == [1000]
    assert pass_time(1000) == ["expired"]


def test_late_terminal_states_and_parts_in_the_wrong_order():
    handle, take, _ = machine()
    assert take(0, [(9, "failed"), (4, "input_required")], [(2, "working"), (5, "completed")]) == ["working", "input_required", "completed"]
    assert take(1, [(1, "cancelled")], [(10, "working")]) == [] and handle.value[0] == "completed" and len(handle.timers) == 1
    handle, take, _ = machine()
    assert take(0, [(1, "working"), (2, None)], [(None, "completed")]) == ["working", "completed"]


def test_tasks_by_event_time_over_a_stream(spark, tmp_path):
    """Two runs of one id: the first expires as the watermark passes it, the second begins anew."""
    pytest.importorskip("google.protobuf")
    schema, source, checkpoint = "task_id string, at timestamp_ntz, status string", str(tmp_path / "in"), str(tmp_path / "cp")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        seen, before = [], []
        for rows in ([("a", at(2), "completed"), ("a", at(1), "working"), ("b", at(1), "working")], [("c", at(4000), "working")], [("a", at(4001), "working"), ("c", at(4002), "failed"), ("c", at(4003), "completed")]):
            df = tasks.stream_tasks(stream(spark, rows, schema, source), late="1 second")
            q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
            assert q.awaitTermination(120)
            now = sorted((r.task_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect())
            seen.append(sorted((Counter(now) - Counter(before)).elements()))
            before = now
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert seen[0] == [("a", "completed"), ("a", "working"), ("b", "working")]
    assert ("a", "expired") in seen[1] + seen[2] and ("b", "expired") in seen[1] + seen[2]
    assert ("a", "working") in seen[2] and ("c", "failed") in seen[2] and ("c", "completed") not in seen[2]
