"""The song table of a collection: its subsets, the columns that a job needs, render folders, and the index of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemloom.functions import exprs as X
from stemloom.operators import planning
from stemloom.sources import files

#: Subsets and the flags that a song of them has.
SUBSETS = {"all": (), "all_valid": ("subset:all_valid",), "rated_deduplicated": ("subset:all_valid", "subset:rated_deduplicated")}
#: Columns that no job needs; they are wide.
WIDE = ("metadata", "mxl", "pdf", "version")
PASSES = ("fluidsynth", "ddsp_piano", "midi_ddsp")


def of_subset(songs: DataFrame, subset: str) -> DataFrame:
    """The songs of a subset; another name is an error."""
    if subset not in SUBSETS:
        raise ValueError(f"unknown subset {subset!r}: {', '.join(SUBSETS)}")
    for flag in SUBSETS[subset]:
        songs = songs.filter(X.parse_bool(F.col(f"`{flag}`")))
    return songs


def read_songs(spark: SparkSession, path: str, columns: Sequence[str], subset: str = "all_valid") -> DataFrame:
    """Some columns, as text, of a subset of a song CSV; flags of the subset are read and dropped."""
    flags = [c for c in SUBSETS.get(subset, ()) if c not in columns]
    return of_subset(files.read_csv_flexible(spark, path, [*columns, *flags]), subset).select(*[F.col(f"`{c}`") for c in columns])


def mid_path(mid: Column, root: str) -> Column:
    """A song's MIDI path below the collection's folder, however it was recorded."""
    return F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(mid, r"^[./]+", ""))


def track_programs(tracks: Column) -> Column:
    """The programs of a song's recorded track list, such as 0-40-73."""
    return F.transform(F.filter(F.split(tracks, "-"), lambda t: F.trim(t) != ""), lambda t: t.cast("int"))


def render_rows(songs: DataFrame, root: str, out: str, tree: str, sample: DataFrame | None = None) -> DataFrame:
    """Valid songs to render, without wide columns and flags, with their paths and output folders.

    Recorded paths begin with a dot, which stands for the collection's folder. `sample` (song_id, place)
    takes only its songs, in its order.
    """
    x = of_subset(songs, "all_valid")
    x = x.drop(*WIDE, *[c for c in x.columns if c.startswith("subset:")])
    here = lambda c: F.concat(F.lit(root.rstrip("/")), F.substring(c, 2, 1 << 20))
    song = X.song_id_from_audio(F.col("path"))
    x = x.withColumn("path_output", F.concat_ws("/", F.lit(out.rstrip("/")), F.lit(tree), song)).withColumn("mid_pdmx", here("mid"))
    x = x.withColumns({"path": here("path"), "mid": F.col("mid_pdmx")})
    if sample is not None:
        x = planning.in_order(x.withColumn("song_id", F.element_at(F.split("path_output", "/"), -1)), sample, "song_id")
    return x


def midi_index(stems: DataFrame, spec: DataFrame, root: str) -> DataFrame:
    """(song_id, mid, n_tracks, n_fluidsynth, n_ddsp_piano, n_midi_ddsp): a song's file and its tracks by pass.

    stems (song_id, track, program, is_drum, name); spec (category, method, fallback). A track's pass
    comes from its category's method and from what its name and program can be rendered by.
    """
    program, drum, name = (F.col(c) for c in ("program", "is_drum", "name"))
    x = stems.select("song_id", "track", X.probe_category(program, drum, name).alias("category"), X.route(program, drum, name)["backend"].alias("route"))
    x = planning.track_plan(x, spec).select("song_id", planning.track_backend(F.col("neural_ok"), F.col("route")).alias("pass"))
    x = x.groupBy("song_id").agg(F.count(F.lit(1)).alias("n_tracks"), *[F.count_if(F.col("pass") == p).alias(f"n_{p}") for p in PASSES])
    return x.select("song_id", F.concat(F.lit(root.rstrip("/") + "/"), "song_id", F.lit(".mid")).alias("mid"), "n_tracks", *[f"n_{p}" for p in PASSES])


def _changed(spark: SparkSession, path: str) -> int:
    """When a path last changed: the newest of its files."""
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = fs.getFileStatus(to)
    if not status.isDirectory():
        return status.getModificationTime()
    found = [x.getModificationTime() for x in fs.listStatus(to) if not x.getPath().getName().startswith(("_", "."))]
    return max(found, default=status.getModificationTime())


def saved_index(spark: SparkSession, path: str, sources: Sequence[str], build) -> DataFrame:
    """The index saved at a path, built and written first where there is none or one of its sources is newer."""
    known = [s for s in sources if files.exists(spark, s)]
    if not files.exists(spark, path) or any(_changed(spark, s) > _changed(spark, path) for s in known):
        build().write.mode("overwrite").option("header", True).csv(path)
    schema = "song_id string, mid string, n_tracks long, " + ", ".join(f"n_{p} long" for p in PASSES)
    return spark.read.schema(schema).option("header", True).csv(path)
