"""Long jobs as streams: what is left to do, what has to be done again, and rows that tell how far they are."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from stemloom.operators.dedupe import keep_last
from stemloom.sources import files, versioned
from stemloom.streaming.upsert import requeued, unfinished

PROGRESS = "at double, event string, query string, run string, batch long, rows long, total_rows long, error string"


class ProgressLog(StreamingQueryListener):
    """Rows (at, event, query, run, batch, rows, total_rows, error) of running streams, as small JSON files in a shared folder.

    A start and an end are always written, progress every `every` seconds at most, with the rows of all
    batches since the last. Each row is a file that appears whole, so readers need no lock.
    """

    def __init__(self, spark: SparkSession, folder: str, every: float = 600.0, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.every, self.clock = spark, folder.rstrip("/"), every, clock
        self.lock = threading.Lock()
        self.totals: dict[str, list[float]] = {}  # by run: rows so far, rows since the last row here, when that was

    def _write(self, event: str, query: str | None, run: str, batch: int | None, rows: int, total: int, error: str | None = None) -> None:
        jvm = self.spark.sparkContext._jvm
        to = jvm.org.apache.hadoop.fs.Path
        name = f"{int(self.clock() * 1000):015d}-{uuid.uuid4().hex}.json"
        fs = to(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = fs.create(to(f"{self.folder}/.{name}"), False)
        row = {"at": self.clock(), "event": event, "query": query, "run": run, "batch": batch, "rows": rows, "total_rows": total, "error": error}
        out.write(bytearray((json.dumps(row) + "\n").encode()))
        out.close()
        fs.rename(to(f"{self.folder}/.{name}"), to(f"{self.folder}/{name}"))

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self.totals[str(event.runId)] = [0, 0, float("-inf")]
        self._write("started", event.name, str(event.runId), None, 0, 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        run = str(p.runId)
        with self.lock:
            t = self.totals.setdefault(run, [0, 0, float("-inf")])
            t[0] += p.numInputRows
            t[1] += p.numInputRows
            if self.clock() - t[2] < self.every:
                return
            rows, total = t[1], t[0]
            t[1], t[2] = 0, self.clock()
        self._write("progress", p.name, run, p.batchId, int(rows), int(total))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        with self.lock:
            t = self.totals.pop(run, [0, 0, 0])
        self._write("failed" if event.exception else "ended", None, run, None, int(t[1]), int(t[0]), (event.exception or "")[:4000] or None)


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a progress log."""
    return spark.read.schema(PROGRESS).json(folder) if files.exists(spark, folder) else spark.createDataFrame([], PROGRESS)


def last_beat(progress: DataFrame) -> DataFrame:
    """(run, event, at, total_rows): the last row of each run; one that only progressed long ago has died."""
    return keep_last(progress.select("run", "event", "at", "total_rows"), ["run"], ["at", "event"])


def work_off(
    stream: DataFrame, target: str, keys: list[str], order: list[str], checkpoint: str, work: Callable[[DataFrame], DataFrame], specs: DataFrame | None = None, name: str | None = None
) -> StreamingQuery:
    """Work through a stream of requests into a versioned table, each key once.

    A batch does the requests whose key the table lacks, and, where `specs` (category, want_method) is
    given, again those rows of the table whose method is no longer the one wanted, with that method. What
    `work` returns replaces the rows of its keys in one commit. A batch that runs again after a crash
    finds its keys done, so nothing is done twice or lost; a batch with nothing to do commits nothing.
    """

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        todo = keep_last(batch, keys, order).persist()  # so that the source's rows are read, and counted, once
        first = todo
        if specs is not None:
            todo = todo.join(specs, "category", "left").withColumn("method", F.coalesce("want_method", "method")).drop("want_method")
        if versioned.versions(spark, target):
            done = versioned.read(spark, target, keys)
            todo = unfinished(todo, done, keys)
            if specs is not None:
                again = requeued(done.select(*batch.columns), specs).drop("method").join(specs, "category").withColumnRenamed("want_method", "method")
                todo = todo.unionByName(again.select(*todo.columns))
        try:
            if not todo.isEmpty():
                versioned.upsert(spark, target, work(todo))
        finally:
            first.unpersist()

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()
