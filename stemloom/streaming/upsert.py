"""Structured Streaming over append-only shards and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stemloom.operators.dedupe import keep_last
from stemloom.sources import files


def stream_parquet(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


#: Parts of a table that a stream keeps up to date; a batch rewrites those that it touches.
BUCKETS = 64


def keep_last_into(stream: DataFrame, target: str, keys: list[str], order: list[str], checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Append-only logs into a table with the last row of each key: each micro-batch is merged by key.

    The table is cut by a hash of the key in `bucket`, and a batch reads and rewrites only the buckets of
    its keys. A batch that is run again gives the same table, and a writer that died is finished first,
    so a restart loses and repeats nothing.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        files.recover(spark, target)
        last = keep_last(batch, keys, order).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in last.select("bucket").distinct().collect()]  # `buckets` at most
        if files.exists(spark, target):
            have = spark.read.parquet(target).filter(F.col("bucket").isin(touched))
            last = keep_last(have.unionByName(last, allowMissingColumns=True), keys, order)
        if touched:
            files.swap(spark, last.repartition("bucket"), target, "bucket")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unfinished(stream: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Resume: rows of a stream whose key isn't done yet (stream-static anti join)."""
    return stream.join(done.select(*keys).distinct(), keys, "left_anti")


def requeued(stream: DataFrame, specs: DataFrame) -> DataFrame:
    """Rows whose recipe differs from their category's present spec; specs (category, want_method) is a fixed list."""
    return stream.join(specs, "category").filter(~F.col("method").eqNullSafe(F.col("want_method"))).drop("want_method")


def windowed_counts(stream: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events of each type in tumbling or sliding windows, with a watermark. (ts, event_type, value)"""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    x = stream.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return x.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    x = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return x.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
