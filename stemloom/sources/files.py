"""Sources and sinks of the catalog's files; paths may be on any store that Spark reaches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from stemloom.operators import merge, register
from stemloom.operators.dedupe import keep_last


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path has anything, asked of its own file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p)) and fs.getContentSummary(p).getLength() > 0


def strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv_flexible(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV whose header may have drifted. Every cell is text; a missing file, and a missing
    column, are empty; short rows are padded, long ones cut, blank ones skipped; only `columns` stay."""
    if not exists(spark, path):
        return spark.createDataFrame([], strings(columns))
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", False).csv(path)
    have = {c.strip(): c for c in raw.columns}
    cells = [F.coalesce(F.col(f"`{have[c]}`"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in columns]
    some = [F.coalesce(F.col(f"`{c}`"), F.lit("")) != "" for c in raw.columns]
    blank = some[0]
    for s in some[1:]:
        blank = blank | s
    return raw.filter(blank).select(*cells)


def cells(df: DataFrame, flags: Sequence[str] = ()) -> DataFrame:
    """Text of each cell: flags as true or false, missing and empty ones as NA."""
    out = []
    for c in df.columns:
        text = F.col(f"`{c}`").cast("string")
        if c in flags:
            out.append(F.when(F.coalesce(F.lower(text), F.lit("")).isin("", "false", "0", "no", "na"), "False").otherwise("True").alias(c))
        else:
            out.append(F.coalesce(F.nullif(text, F.lit("")), F.lit("NA")).alias(c))
    return df.select(*out)


def append(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Add rows to a table of Parquet files; columns of later batches are merged when it is read."""
    df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("append").parquet(path)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def upsert(spark: SparkSession, path: str, batch: DataFrame, keys: list[str]) -> None:
    """Replace rows by key; the new version is written beside the old one and put in its place.

    One writer at a time, as with any table without a transaction log. A writer that died on the way is
    finished first.
    """
    recover(spark, path)
    new = batch if not exists(spark, path) else merge.upsert(spark.read.parquet(path), batch, keys)
    swap(spark, new, path)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return p, p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str) -> None:
    """Put the finished folder beside a path in its place, part by part where it is partitioned.

    What is deleted is always there in a finished copy; each step may be repeated after a crash.
    """
    to, fs = _fs(spark, path)
    parts = [x.getPath().getName() for x in fs.listStatus(to(f"{path}.new")) if x.isDirectory() and "=" in x.getPath().getName()]
    if not parts:
        fs.delete(to(path), True)
        fs.rename(to(f"{path}.new"), to(path))
        return
    fs.mkdirs(to(path))
    for name in parts:
        fs.delete(to(f"{path}/{name}"), True)
        fs.rename(to(f"{path}.new/{name}"), to(f"{path}/{name}"))
    fs.delete(to(f"{path}.new"), True)


def recover(spark: SparkSession, path: str) -> None:
    """Finish what a writer that died had begun: a finished folder is put in place, an unfinished one counts for nothing."""
    to, fs = _fs(spark, path)
    if fs.exists(to(f"{path}.new/_SUCCESS")):
        _put(spark, path)


def swap(spark: SparkSession, df: DataFrame, path: str, part: str | None = None) -> None:
    """Write beside a path, then put it in the path's place; with `part`, only the parts that df has."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(part) if part else writer).parquet(f"{path}.new")
    _put(spark, path)


def write_json(df: DataFrame, path: str) -> None:
    """A small table, such as a summary or a saved sample, as one file of JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_sample(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A saved sample."""
    return spark.read.schema(schema).json(path)


def read_assignment(spark: SparkSession, path: str) -> DataFrame:
    """(song_id, chunk) of a table in which each song stands once, else an error."""
    x = spark.read.schema("song_id string, chunk int").option("header", True).csv(path)
    twice = x.groupBy("song_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(3).collect()
    if twice:
        raise ValueError(f"songs with more than one chunk: {', '.join(str(r.song_id) for r in twice)}")
    return x


def write_assignment(frozen: DataFrame, new: DataFrame, path: str) -> None:
    """Frozen assignments with the new ones, those of frozen songs left as they are."""
    merge.frozen_wins(frozen, new, "song_id").write.mode("overwrite").option("header", True).csv(path)


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """An alias dimension (list, needle, program, gm_class) from a small file of the listing kind.

    The file has sections `generic_skip` (lines `- name`), `family_defaults` and `aliases` (lines
    `- needle: name`, then `program:` and `gm_class:`); quotes are taken off, comments and blank lines skipped.
    A needle without a program, and a section of another name, is an error.
    """
    line = F.regexp_replace("line", r"\s+#.*$|^\s*#.*$", "")
    x = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line")).select("at", line.alias("line"))
    x = x.filter(F.trim("line") != "").withColumn("section", F.nullif(F.regexp_extract("line", r"^(\w+)\s*:", 1), F.lit("")))
    so_far = W.partitionBy(F.lit(0)).orderBy("at")  # one file of a few hundred lines
    x = x.withColumn("entry", F.sum(F.col("line").rlike(r"^\s*-").cast("int")).over(so_far)).withColumn("section", F.last("section", True).over(so_far))
    part = F.regexp_replace("line", r"^\s*-\s*", "")
    value = F.regexp_replace(F.trim(F.regexp_replace(part, r"^\s*(needle|program|gm_class)\s*:", "")), r"^(['\"])(.*)\1$", "$2")
    field = F.when(F.col("section") == "generic_skip", "needle").otherwise(F.regexp_extract(part, r"^\s*(needle|program|gm_class)\s*:", 1))
    kind = F.when(F.col("section") == "generic_skip", "skip").when(F.col("section") == "family_defaults", "family").when(F.col("section") == "aliases", "alias")
    x = x.filter(~F.col("line").rlike(r"^\w+\s*:")).select(F.coalesce(kind, F.raise_error(F.concat(F.lit("unknown section "), F.coalesce("section", F.lit("")))).cast("string")).alias("list"), "entry", field.alias("field"), value.alias("value"))
    one = lambda f: F.max(F.when(F.col("field") == f, F.col("value"))).alias(f)
    x = x.groupBy("list", "entry").agg(one("needle"), one("program"), one("gm_class"))
    whole = (F.col("list") == "skip") | F.col("program").isNotNull()
    program = F.when(whole, F.col("program")).otherwise(F.raise_error(F.concat(F.lit("no program for "), F.coalesce("needle", F.lit("an entry")))).cast("string"))
    return register.dimension(x.select("list", F.coalesce("needle", F.lit("")).alias("needle"), program.cast("int").alias("program"), "gm_class"))


def first_existing_path(spark: SparkSession, candidates: Sequence[str]) -> str | None:
    """The first of some paths that exists."""
    return next((p for p in candidates if exists(spark, p)), None)


def write_csv(df: DataFrame, path: str, compressed: bool = True) -> None:
    """A CSV, gzipped for release, missing cells as NA."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "NA").option("compression", "gzip" if compressed else "none").csv(path)


def read_jsonl(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """JSON lines of the files that there are."""
    found = [p for p in paths if exists(spark, p)]
    return spark.read.schema(schema).json(found) if found else spark.createDataFrame([], schema)


def merge_ranks(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Rows of several ranks' files (file, line), the last one of each key; non-finite numbers are null."""
    x = keep_last(df, [key], ["file", "line"])
    for m in metrics:
        x = x.withColumn(m, finite(F.col(m)))
    return x.drop("file", "line")


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(c) | c.isin(float("inf"), float("-inf")), None).otherwise(c)


RATINGS = "listener_id string, complete boolean, ratings array<struct<trial_id:string, stem_id:string, category:string, samples:array<struct<variant_id:string, content:double, realism:double>>>>"


def ratings_rows(responses: DataFrame) -> DataFrame:
    """One row a rated sample of complete nested responses."""
    x = responses.filter(F.coalesce("complete", F.lit(True))).select("listener_id", F.explode("ratings").alias("r"))
    return x.select("listener_id", "r.trial_id", "r.stem_id", "r.category", F.explode("r.samples").alias("s")).select("listener_id", "trial_id", "stem_id", "category", "s.*")


VOTES = "votes array<struct<card_id:string, category:string, stem_id:string, clip_id:string, variant_id:string, tier:string>>"


def votes_rows(responses: DataFrame) -> DataFrame:
    """S20."""
    return responses.select(F.explode("votes").alias("v")).select("v.*")


def song_index(songs: DataFrame, stems: DataFrame) -> DataFrame:
    """One record a song with its stems nested, in track order; a song's stems are few."""
    nested = stems.groupBy("song_id").agg(F.sort_array(F.collect_list(F.struct("track", "program", "is_drum"))).alias("stems"))
    return songs.join(nested, "song_id")


def flattened(index: DataFrame) -> DataFrame:
    """The stems of an index, a row each."""
    return index.select("song_id", F.explode("stems").alias("s")).select("song_id", "s.*")


def merge_catalogs(*catalogs: DataFrame) -> DataFrame:
    """Several catalogs by id; a later one wins."""
    return merge.merge_shards(list(catalogs), ["id"], ["id"])


def _varint(data: bytes, at: int) -> tuple[int, int]:
    n = 0
    while True:
        b = data[at]
        n, at = n << 7 | b & 0x7F, at + 1
        if b < 0x80:
            return n, at


def midi_tracks(data: bytes) -> list[tuple[int, str | None, int, bool, int]] | None:
    """(track, name, program, is_drum, notes) of a standard MIDI file; None for what is none.

    The last program change holds; a track is drums when its first channel message is on channel 10.
    """
    try:
        if data[:4] != b"MThd":
            return None
        at, out = 8 + int.from_bytes(data[4:8], "big"), []
        while at + 8 <= len(data):
            kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "big")
            pos, end, at = at + 8, at + 8 + size, at + 8 + size
            if kind != b"MTrk":
                continue
            name, program, channel, notes, status = None, 0, None, 0, 0
            while pos < end:
                _, pos = _varint(data, pos)
                if data[pos] >= 0x80:
                    status, pos = data[pos], pos + 1
                if status == 0xFF:
                    meta = data[pos]
                    n, pos = _varint(data, pos + 1)
                    if meta == 3:
                        name = data[pos : pos + n].decode("utf-8", "replace")
                    pos += n
                elif status in (0xF0, 0xF7):
                    n, pos = _varint(data, pos)
                    pos += n
                else:
                    channel = status & 15 if channel is None else channel
                    op = status >> 4
                    program = data[pos] if op == 12 else program
                    notes += op == 9 and data[pos + 1] > 0
                    pos += 1 if op in (12, 13) else 2
            out.append((len(out), name, program, channel == 9, notes))
        return out
    except IndexError:
        return None


MIDI = "path string, ok boolean, track int, name string, program int, is_drum boolean, notes int"


def read_midi(spark: SparkSession, path: str) -> DataFrame:
    """The tracks of MIDI files under a path, empty ones too; a bad file is one row, not ok."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, data in zip(b["path"], b["content"], strict=True):
                tracks = midi_tracks(bytes(data))
                rows += [(p, True, *t) for t in tracks] if tracks is not None else [(p, False, None, None, None, None, None)]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in MIDI.split(", ")]).astype({"track": "Int32", "program": "Int32", "notes": "Int32", "is_drum": "boolean"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mid").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(parse, MIDI)


def flac_seconds(content: Column) -> Column:
    """Seconds of a FLAC file from its stream header, null when it is none, in the JVM."""
    h = F.hex(F.substring(content, 1, 26))
    number = lambda a, n: F.conv(F.substring(h, a, n), 16, 10).cast("long")
    rate, frames = F.shiftright(number(37, 6), 4), number(44, 9)
    ok = F.startswith(h, F.lit("664C6143")) & (rate > 0) & (frames > 0)
    return F.when(ok, frames / rate)


def file_sizes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes) of the files under a path, from the listing alone."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return x.select("path", F.col("length").alias("bytes"))


def first_existing(rows: DataFrame, candidates: Sequence[str], listing: DataFrame) -> DataFrame:
    """The first of several candidate path columns that the listing has."""
    x = rows
    for k, c in enumerate(candidates):
        there = listing.select(F.col("path").alias(f"_p{k}")).distinct()
        x = x.join(there, x[c] == there[f"_p{k}"], "left")
    return x.withColumn("resolved", F.coalesce(*[F.col(f"_p{k}") for k in range(len(candidates))])).drop(*[f"_p{k}" for k in range(len(candidates))])


def numbered(df: DataFrame, by: str, key: str) -> DataFrame:
    """Records of each split numbered from 0."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(key)) - 1)
