"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "stemloom", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own session."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("STEMLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables; the path may be on any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, stem: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir.

    A session of one machine (tests, a laptop) may leave it unset and gets a temporary folder. On a
    cluster that is an error: executors would each write to a disk of their own.
    """
    ctx = spark.sparkContext
    named = ctx.getConf().get("spark.checkpoint.dir") or ctx.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", ctx.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="stemloom-")
    return f"{named.rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever store Spark keeps it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise in the cluster's shared checkpoint folder and cut the lineage."""
    ctx = df.sparkSession.sparkContext
    if ctx.getCheckpointDir() is None:
        ctx.setCheckpointDir(ctx.getConf().get("spark.checkpoint.dir") or shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)
