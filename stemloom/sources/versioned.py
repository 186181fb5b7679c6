"""Tables that many writers upsert at once: immutable segments of rows, and versions that are committed optimistically.

A table is a folder with `data/<id>`, one Parquet folder for each batch, and `versions/<number>.json`,
which lists the batches of that version in their order. A writer writes its batch, which nobody sees, then
publishes the next version under a name that only one writer can create; the one that loses reads the
version that won and tries again with the next number, without writing its batch again. Of rows with
equal keys those of the last batch that has the key hold. A reader takes the latest version and isn't
disturbed by what is published after it; nothing that a version lists is changed or moved.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemloom.session import removed

#: How often a writer tries to publish, and the longest pause between two tries, in seconds.
TRIES, PAUSE = 200, 0.5
_DIGITS = 20


class ConflictError(RuntimeError):
    """A version could not be published because other writers were always faster."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.Path, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the published versions, ascending."""
    to, fs = _fs(spark, path)
    if not fs.exists(to(f"{path}/versions")):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(to(f"{path}/versions"))]
    return sorted(int(n[:_DIGITS]) for n in names if n.endswith(".json") and n[:_DIGITS].isdigit())


def batches(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[str]]:
    """(number, batches in their order) of a version, the latest one by default; 0 is the empty table."""
    if version is None:
        version = max(versions(spark, path), default=0)
    if not version:
        return 0, []
    text = spark.read.text(f"{path}/versions/{version:0{_DIGITS}d}.json", wholetext=True).first()[0]
    return version, json.loads(text)["batches"]


def _published(spark: SparkSession, path: str, version: int, listed: list[str]) -> bool:
    """Whether this writer created the version: its file appears whole, and only if there is none of its name."""
    to, fs = _fs(spark, path)
    final, draft = f"{path}/versions/{version:0{_DIGITS}d}.json", f"{path}/versions/.{uuid.uuid4().hex}"
    out = fs.create(to(draft), False)
    out.write(bytearray(json.dumps({"batches": listed}).encode()))
    out.close()
    try:
        if fs.getScheme() != "file":
            return bool(fs.rename(to(draft), to(final)))  # a name node refuses a name that is taken
        jvm = spark.sparkContext._jvm
        local = lambda x: jvm.java.io.File(to(x).toUri().getPath()).toPath()
        try:
            jvm.java.nio.file.Files.createLink(local(final), local(draft))  # so does the kernel
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True
    finally:
        fs.delete(to(draft), False)


def _commit(spark: SparkSession, path: str, change, tries: int) -> int:
    """Publish what `change` makes of the latest batches, again and again until no other writer came first."""
    for k in range(tries):
        version, listed = batches(spark, path)
        if (wanted := change(listed)) is None:
            return version
        if _published(spark, path, version + 1, wanted):
            return version + 1
        time.sleep(random.random() * min(PAUSE, 0.01 * 2 ** min(k, 8)))
    raise ConflictError(f"{path}: no version published in {tries} tries")


def upsert(spark: SparkSession, path: str, batch: DataFrame, tries: int = TRIES) -> int:
    """Add a batch whose rows replace those of earlier batches with the same keys; gives the version.

    Any number of writers may do so at a time, in threads, in processes or on several machines, on a
    store that refuses to create a name twice (HDFS by rename, a local disk by link). A writer that dies
    before it publishes leaves a batch that no version lists.
    """
    name = uuid.uuid4().hex
    batch.write.parquet(f"{path}/data/{name}")
    return _commit(spark, path, lambda listed: [*listed, name], tries)


def read(spark: SparkSession, path: str, keys: Sequence[str], version: int | None = None) -> DataFrame:
    """The rows of a version: of each key, those of the last batch that has it. Columns that a batch lacks are null.

    Null keys are keys like others. One window by key; the batch that holds a row comes from its file's name.
    """
    _, listed = batches(spark, path, version)
    if not listed:
        raise FileNotFoundError(f"{path} has no version")
    return _merged(spark, path, listed, keys)


def _merged(spark: SparkSession, path: str, listed: list[str], keys: Sequence[str]) -> DataFrame:
    x = spark.read.option("mergeSchema", True).parquet(*[f"{path}/data/{b}" for b in listed])
    columns, place = x.columns, "_batch"
    while place in columns:
        place += "_"
    if len(listed) == 1:
        return x
    order = F.create_map(*[F.lit(v) for k, b in enumerate(listed) for v in (b, k)])
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/data/([0-9a-f]{32})/", 1)
    x = x.select(*[F.col(f"`{c}`") for c in columns], F.element_at(order, name).alias(place))
    last = f"{place}last"
    x = x.withColumn(last, F.max(place).over(W.partitionBy(*[F.col(f"`{k}`") for k in keys])))
    return x.filter(F.col(place) == F.col(last)).select(*[F.col(f"`{c}`") for c in columns])


def compact(spark: SparkSession, path: str, keys: Sequence[str], tries: int = TRIES) -> int:
    """Write the batches of the latest version as one. Batches published meanwhile stay after it; gives the version."""
    _, old = batches(spark, path)
    if len(old) < 2:
        return _commit(spark, path, lambda listed: None, tries)
    name = uuid.uuid4().hex
    _merged(spark, path, old, keys).write.parquet(f"{path}/data/{name}")
    # another compaction came first: leave its result, this one's batch is never listed
    return _commit(spark, path, lambda listed: [name, *listed[len(old) :]] if listed[: len(old)] == old else None, tries)


def vacuum(spark: SparkSession, path: str, keep: int = 2, older_than: float = 24 * 3600) -> int:
    """Remove versions but the last `keep`, and batches that none of those lists and that are older than so many seconds.

    The age spares batches whose writers haven't published yet. Readers of older versions must be done.
    """
    to, fs = _fs(spark, path)
    numbers = versions(spark, path)
    listed = {b for v in numbers[-keep:] for b in batches(spark, path, v)[1]}
    for v in numbers[:-keep]:
        fs.delete(to(f"{path}/versions/{v:0{_DIGITS}d}.json"), False)
    old = [x.getPath() for x in fs.listStatus(to(f"{path}/data")) if x.getModificationTime() < (time.time() - older_than) * 1000]
    gone = [p for p in old if p.getName() not in listed]
    for p in gone:
        removed(spark, p.toString())
    return len(gone)
