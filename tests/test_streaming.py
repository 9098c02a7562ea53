import pytest
from pyspark.sql import functions as F

from gradeloom.plans import domain
from gradeloom.streaming import export_state as E
from gradeloom.streaming import logs


def run(*events):
    r, out = E.Record(), []
    for e in events:
        kind, at, *rest = e
        E.advance(r, kind, at, **(rest[0] if rest else {}))
        out.append(E.shown(r))
    return r, out


def test_machine():
    _, out = run(("request", 1), ("source", 2), ("request", 3), ("start", 4), ("finish", 5, {"text": "t"}))
    assert out == ["missing", "stale", "queued", "rendering", "ready"]
    r, out = run(("source", 2), ("request", 3), ("start", 4), ("source", 9), ("finish", 10, {"text": "t"}))
    assert out[-1] == "queued" and r.urgent and not r.text  # changed while it ran
    r, out = run(("source", 2), ("request", 3), ("start", 4), ("request", 5), ("finish", 6, {"error": "e"}))
    assert out[-1] == "queued" and r.error == ""  # asked for again, even though it failed
    r, out = run(("source", 2), ("request", 3), ("start", 4), ("finish", 6, {"error": "e"}))
    assert r.status == "error" and out[-1] == "stale" and r.error == "e"
    r, out = run(("source", 2), ("request", 3), ("start", 4), ("finish", 5, {"text": "t"}), ("source", 8), ("gone", 9))
    assert out[-2:] == ["stale", "missing"]
    r, _ = run(("source", 2), ("request", 3, {"urgent": True}), ("request", 4))
    assert r.urgent and r.status == "queued"
    _, out = run(("start", 1), ("finish", 2, {"text": "t"}))
    assert out == ["missing", "missing"]


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = domain.export_events(spark, "/root/testdata/sf0.001").orderBy("seq")
    for i in range(3):
        events.where(F.col("seq") % 3 >= 0).where((F.col("seq") >= i * 400) & (F.col("seq") < (i + 1) * 400)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(E.EVENT_SCHEMA).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    q = E.export_stream(stream).writeStream.format("memory").queryName("exports").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
        assert q.exception() is None
    finally:
        q.stop()
    got = sorted(map(tuple, spark.sql("select * from exports").collect()))
    want = sorted(map(tuple, E.export_batch(events).collect()))
    assert got == want and len(want) == 1000


def test_log_tail_loses_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    lines = logs.read_log_stream(spark, str(tmp_path / "in"))
    for part in range(2):
        (tmp_path / "in" / f"t{part}.log").write_text("".join(f"line {part} {i}\n" for i in range(200)) + "\n[CMD] run\n")
        q = logs.start_tail(logs.shown_lines(lines), lambda df, n: seen.extend(map(tuple, df.collect())), str(tmp_path / "cp"))
        q.awaitTermination(60)
    assert sorted(seen) == sorted((f"t{p}", f"line {p} {i}") for p in range(2) for i in range(200))


def test_watermarked_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = logs.activity(stream).writeStream.format("memory").queryName("activity").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) as n from activity").first().n == events.count()


def test_status_and_guard(spark):
    codes = spark.createDataFrame([(None,), (0,), (3,)], "c int").select(logs.final_status(F.col("c")).alias("s")).collect()
    assert [r.s for r in codes] == ["running", "success", "failed"]
    asks = spark.createDataFrame([("a", "w", 1), ("a", "w", 2), ("b", "w", 3)], "task string, weekId string, seq int")
    tasks = spark.createDataFrame([("b", "w", "running"), ("a", "w", "success")], "task string, weekId string, status string")
    assert [r.seq for r in logs.may_start(asks, tasks).collect()] == [1]


@pytest.mark.parametrize("started, want", [([(1, 5.0), (2, 5.0)], 1), ([(1, 5.0), (2, 6.0)], 2)])
def test_latest_task_ties(spark, started, want):
    rows = spark.createDataFrame([("g", "w", s, t) for s, t in started], "task string, weekId string, seq int, startedAt double")
    assert logs.latest_tasks(rows).first().seq == want
