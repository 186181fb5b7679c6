"""Streams that work off requests: restarts, re-queued rows, and their progress rows."""

import time

import pytest
from pyspark.sql import functions as F

from stemloom.sources import versioned
from stemloom.streaming import jobs
from stemloom.streaming.upsert import requeued, stream_parquet, unfinished

SCHEMA = "song_id string, track int, category string, method string, p long"


@pytest.fixture
def folder(spark, tmp_path):
    def add(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    return tmp_path, add


def run(spark, tmp_path, work, specs=None, name=None):
    stream = stream_parquet(spark, f"{tmp_path}/in", SCHEMA)
    q = jobs.work_off(stream, f"{tmp_path}/out", ["song_id", "track"], ["p"], f"{tmp_path}/cp", work, specs, name)
    q.awaitTermination(120)
    return q


def table(spark, tmp_path):
    return sorted((r.song_id, r.track, r.method, r.done) for r in versioned.read(spark, f"{tmp_path}/out", ["song_id", "track"]).collect())


def test_work_survives_restarts_and_changed_specs(spark, folder):
    tmp_path, add = folder
    seen = []

    def work(todo):
        rows = [(r.song_id, r.track) for r in todo.collect()]
        seen.append(sorted(rows))
        return todo.withColumn("done", F.concat(F.col("method"), F.lit("!")))

    add([("a", 0, "piano", "x", 1), ("a", 0, "piano", "y", 2), ("b", 0, "drums", "x", 1)])
    run(spark, tmp_path, work)
    assert table(spark, tmp_path) == [("a", 0, "y", "y!"), ("b", 0, "x", "x!")]
    add([("a", 0, "piano", "z", 3), ("c", 1, "drums", "x", 1)])  # a is done already
    run(spark, tmp_path, work)
    assert seen[-1] == [("c", 1)] and len(table(spark, tmp_path)) == 3

    def dies(todo):
        raise RuntimeError("lost")

    add([("d", 0, "drums", "x", 1)])
    with pytest.raises(Exception, match="lost"):
        run(spark, tmp_path, dies)
    run(spark, tmp_path, work)  # the batch is run again from the checkpoint
    assert seen[-1] == [("d", 0)]
    versions = versioned.versions(spark, f"{tmp_path}/out")
    run(spark, tmp_path, work)
    assert versioned.versions(spark, f"{tmp_path}/out") == versions  # nothing new, nothing committed
    specs = spark.createDataFrame([("piano", "new"), ("drums", "x")], "category string, want_method string")
    add([("e", 0, "piano", "old", 1)])
    run(spark, tmp_path, work, specs)
    assert seen[-1] == [("a", 0), ("e", 0)]
    assert table(spark, tmp_path) == [("a", 0, "new", "new!"), ("b", 0, "x", "x!"), ("c", 1, "x", "x!"), ("d", 0, "x", "x!"), ("e", 0, "new", "new!")]


def test_unfinished_and_requeued_on_a_running_stream(spark, folder):
    tmp_path, add = folder
    add([("a", 0, "piano", "x", 1), ("b", 0, "drums", "x", 1), ("c", 0, "wind", "x", 1)])
    done = spark.createDataFrame([("a", 0)], "song_id string, track int")
    specs = spark.createDataFrame([("drums", "y"), ("wind", "x")], "category string, want_method string")
    stream = stream_parquet(spark, f"{tmp_path}/in", SCHEMA)
    for k, x in enumerate((unfinished(stream, done, ["song_id", "track"]), requeued(stream, specs))):
        q = x.writeStream.format("memory").queryName(f"left{k}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {r.song_id for r in spark.table("left0").collect()} == {"b", "c"}
    assert {r.song_id for r in spark.table("left1").collect()} == {"b"}


def test_progress_rows(spark, folder):
    tmp_path, add = folder
    now = [1000.0]
    log = jobs.ProgressLog(spark, f"{tmp_path}/log", every=0.0, clock=lambda: now[0])
    spark.streams.addListener(log)
    try:
        add([("a", 0, "piano", "x", 1), ("b", 0, "piano", "x", 1)])
        first = run(spark, tmp_path, lambda t: t, name="renders")
        add([("c", 0, "piano", "x", 1)])
        second = run(spark, tmp_path, lambda t: t, name="renders")

        def dies(todo):
            raise RuntimeError("lost")

        add([("d", 0, "piano", "x", 1)])
        with pytest.raises(Exception, match="lost"):
            run(spark, tmp_path, dies, name="renders")
        for _ in range(100):
            got = jobs.read_progress(spark, f"{tmp_path}/log").collect()
            if sum(r.event in ("ended", "failed") for r in got) == 3:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    events = {run_id: [r.event for r in got if r.run == run_id] for run_id in {r.run for r in got}}
    assert len(events) == 3 and all("started" in e for e in events.values())
    totals = {r.run: r.total_rows for r in got if r.event == "ended"}
    assert totals == {str(first.runId): 2, str(second.runId): 1}
    assert all("lost" in r.error for r in got if r.event == "failed")
    assert jobs.last_beat(jobs.read_progress(spark, f"{tmp_path}/log")).count() == 3
    assert jobs.read_progress(spark, f"{tmp_path}/none").count() == 0


def test_progress_is_throttled(spark, tmp_path):
    now, wrote = [0.0], []
    log = jobs.ProgressLog(spark, f"{tmp_path}/log", every=600, clock=lambda: now[0])
    log._write = lambda *row: wrote.append(row)

    class Event:
        def __init__(self, k):
            self.progress = type("P", (), {"runId": "r", "numInputRows": 5, "name": "n", "batchId": k})

    for k in range(5):
        now[0] = k * 300.0
        log.onQueryProgress(Event(k))
    assert [(r[0], r[3], r[4], r[5]) for r in wrote] == [("progress", 0, 5, 5), ("progress", 2, 10, 15), ("progress", 4, 10, 25)]
