"""Song-level tables from stem-level rows, packaging tables and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemloom.functions import exprs as X

TARGET_NAMES = ("bass", "drums", "guitar", "piano")


def pipe_join(c: Column) -> Column:
    """Sorted distinct values of a group joined by pipes, numbers in numeric order."""
    return F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda v: v.cast("string")), "|")


def songs_table(stems: DataFrame, order: list[str]) -> DataFrame:
    """One row a song: first non-null name, counts, pipe-joined sets and subset flags.

    A song's sets are small (tracks, 128 programs, 17 classes, 4 targets), so collecting them is bounded.
    """
    x = stems.withColumn("gm_class", X.gm_class(F.col("program"), F.col("is_drum"))).withColumn("target", X.separation_target(F.col("program"), F.col("is_drum")))
    first = F.min_by("name", F.when(F.col("name").isNotNull(), F.struct("track", *order)))
    g = x.groupBy("song_id").agg(
        first.alias("name"),
        F.count(F.lit(1)).alias("n_tracks"),
        F.sum(F.col("present").cast("long")).alias("n_stems_on_disk"),
        F.max("wall_seconds").alias("song_length"),
        pipe_join(F.col("track")).alias("tracks"),
        pipe_join(F.col("program")).alias("programs"),
        pipe_join(F.col("gm_class")).alias("gm_classes"),
        pipe_join(F.col("target")).alias("targets"),
        F.countDistinct("target").alias("n_targets"),
    )
    full = F.col("n_targets") == len(TARGET_NAMES)
    return g.select("*", F.lit(True).alias("subset_all"), full.alias("subset_bdgp"), (F.col("n_tracks") > 1).alias("subset_multitrack")).drop("n_targets")


def songs_table_checked(stems: DataFrame) -> DataFrame:
    """Sets over present stems only, n_tracks over all rows, songs without any present stem gone."""
    here = F.col("present")
    g = stems.groupBy("song_id").agg(
        F.count(F.lit(1)).alias("n_tracks"),
        F.sum(here.cast("long")).alias("n_stems_on_disk"),
        pipe_join(F.when(here, F.col("track"))).alias("tracks"),
        pipe_join(F.when(here, F.col("program"))).alias("programs"),
        F.min_by("name", "track").alias("head_name"),
    )
    return g.filter("n_stems_on_disk > 0")


def divides(stems: DataFrame, key: str, value: Column, wanted: tuple[str, ...]) -> DataFrame:
    """Keys that have every wanted value (relational division)."""
    hit = stems.select(key, value.alias("v")).filter(F.col("v").isin(*wanted))
    return hit.groupBy(key).agg(F.countDistinct("v").alias("n")).filter(F.col("n") == len(wanted)).select(key)


def without_cover(songs: DataFrame, routing: DataFrame) -> DataFrame:
    """Songs (song_id, n) whose routing doesn't cover tracks 0 to n - 1."""
    seen = routing.select("song_id", "track").distinct().groupBy("song_id").agg(F.collect_set("track").alias("seen"))
    x = songs.filter("n > 0").join(seen, "song_id", "left")
    need = F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))
    return x.filter(F.size(F.array_except(need, F.coalesce("seen", F.array().cast("array<int>")))) > 0).select("song_id")


def chunk_manifest(stems: DataFrame, song_chunk: DataFrame, sizes: DataFrame) -> DataFrame:
    """Songs, stems and bytes of each chunk."""
    per_song = stems.groupBy("song_id").agg(F.count(F.lit(1)).alias("n"))
    x = song_chunk.join(per_song, "song_id", "left").join(sizes, "song_id", "left")
    return x.groupBy("chunk").agg(F.count(F.lit(1)).alias("n_songs"), F.sum(F.coalesce("n", F.lit(0))).alias("n_stems"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"))


def matched_or_raise(left: DataFrame, right: DataFrame, key: str, what: str) -> DataFrame:
    """An inner join that first makes sure that no key is unmatched; five are shown."""
    lost = left.join(right, key, "left_anti").select(key).distinct().limit(5).collect()
    if lost:
        raise ValueError(f"{what}: no match for {[r[0] for r in lost]}")
    return left.join(right, key)


def chunk_paths(rows: DataFrame) -> DataFrame:
    """Paths of packaged files from (song_id, chunk)."""
    base = F.concat(F.lit("./chunk_"), F.col("chunk").cast("string"), F.lit("/"), F.col("song_id"))
    return rows.withColumn("path", base).withColumn("mid", F.concat(base, F.lit(".mid"))).withColumn("mix", F.concat(base, F.lit("/mix.flac")))


def rewritten(left: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Take a column's new value where there is one."""
    n = new.select(key, F.col(column).alias("_new"))
    return left.join(n, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def pass_counts(stems: DataFrame, passes: tuple[str, ...]) -> DataFrame:
    """Stems of each pass as columns, zero-filled."""
    x = stems.groupBy("song_id").pivot("pass", list(passes)).count().na.fill(0)
    return x.select("song_id", *[F.col(p).alias(f"n_{p}") for p in passes])


def pass_progress(assigned: DataFrame, done: DataFrame) -> DataFrame:
    """Done clamped to what is assigned, fallbacks credited to the room that is left.

    assigned (song_id, n_neural, n_native); done (song_id, neural, fallback, native).
    """
    x = assigned.join(done, "song_id", "left").na.fill(0)
    neural = F.least("neural", "n_neural")
    credit = F.least(F.col("fallback"), F.greatest(F.lit(0), F.col("n_neural") - neural))
    native = F.least(F.col("native") + F.col("fallback") - credit, F.col("n_native"))
    left = F.col("n_neural") - neural - credit + F.col("n_native") - native
    return x.select("song_id", neural.alias("neural_done"), credit.alias("credit"), native.alias("native_done"), left.alias("remaining"))


def complete_songs(stems: DataFrame, songs: DataFrame) -> DataFrame:
    """Songs (song_id, n_tracks) with at least so many distinct tracks."""
    got = stems.groupBy("song_id").agg(F.countDistinct("track").alias("got"))
    return songs.join(got, "song_id").filter("got >= n_tracks").select("song_id", "got")


def dense_tracks(stems: DataFrame) -> DataFrame:
    """Tracks renumbered from 0 without gaps among the kept ones."""
    w = W.partitionBy("song_id").orderBy("track")  # a song's tracks are few
    return stems.withColumn("original_track", F.col("track")).withColumn("track", (F.row_number().over(w) - 1).cast("int"))


def velocity_scales(tracks: DataFrame) -> DataFrame:
    """Each track's maximum over its song's; 0 for silent tracks, 1 for silent songs."""
    top = F.max("peak").over(W.partitionBy("song_id"))
    scale = F.when(F.col("peak") <= 0, 0.0).when(top <= 0, 1.0).otherwise(F.col("peak") / top)
    return tracks.withColumn("scale", F.when(top <= 0, 1.0).otherwise(scale))


def complete_map(rows: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """A map of each key's values, null if one value is missing."""
    m = F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, value))))
    return rows.groupBy(key).agg(F.when(F.count_if(F.col(value).isNull()) == 0, m).alias("scales"))
