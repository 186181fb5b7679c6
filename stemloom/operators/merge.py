"""Merging, upserting and set operations on keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedupe import keep_last


def union_all(*tables: DataFrame) -> DataFrame:
    """Tables one under another by name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def merge_shards(shards: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; a later shard wins over an earlier one."""
    numbered = [s.withColumn("_shard", F.lit(k)) for k, s in enumerate(shards)]
    return keep_last(union_all(*numbered), keys, ["_shard", *order]).drop("_shard")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows without the batch's keys, then the whole batch, its repeats included."""
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming, allowMissingColumns=True)


def delete_keys(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key isn't in the given table."""
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def frozen_wins(frozen: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All frozen rows, and the new ones of other keys."""
    return frozen.unionByName(new.join(frozen.select(key), key, "left_anti"))


def restrict(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in the given table."""
    return table.join(keys.select(*on).distinct(), on, "left_semi")


def lookup(table: DataFrame, dim: DataFrame, on: list[str], column: str, default: Column) -> DataFrame:
    """A column of a keyed table, with a default."""
    return table.join(dim.select(*on, F.col(column).alias("_found")), on, "left").withColumn(column, F.coalesce(F.col("_found"), default)).drop("_found")


def covers(src: DataFrame, dst: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, covered): whether every row of src is in dst, group by group; dst may have more."""
    there = dst.select(group, *columns).distinct().withColumn("_there", F.lit(True))
    x = src.select(group, *columns).distinct().join(there, [group, *columns], "left")
    return x.groupBy(group).agg(F.bool_and(F.coalesce("_there", F.lit(False))).alias("covered"))


def contained(a: DataFrame, b: DataFrame) -> bool:
    """Whether every row of a is in b."""
    return a.exceptAll(b).isEmpty()


def partition_ids(ids: DataFrame, chunk: str, parts: int = 2) -> DataFrame:
    """Distinct ids of each part, in order. The ids of chunks are few."""
    x = ids.select(F.col(chunk).cast("int").alias("c")).distinct()
    return x.groupBy((F.pmod("c", F.lit(parts)) + 1).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda v: v.cast("string")), "|").alias("chunks"))


def provenance(stems: DataFrame, recipe: DataFrame, basic_id: str = "basic") -> DataFrame:
    """Recipe of each stem, and where its soundfont id comes from; the strongest rule is tried first."""
    x = stems.select("song_id", "track").join(recipe.select("song_id", "track", "category", "method", "backend", "fallback", "soundfont_id"), ["song_id", "track"], "left")
    recorded = F.trim(F.coalesce("soundfont_id", F.lit(""))) != ""
    slakh = (F.col("method") == "slakh") | ((F.col("method") == "midi-ddsp") & (F.col("fallback") == "slakh"))
    p = (
        F.when(recorded, "recorded")
        .when(F.col("backend").isNull(), "missing_recipe")
        .when(F.col("backend").isin("midi_ddsp", "ddsp_piano"), "neural")
        .when(slakh, "slakh_unlogged")
        .otherwise("basic_default")
    )
    x = x.withColumn("provenance", p)
    font = F.when(F.col("provenance") == "recorded", F.trim("soundfont_id")).when(F.col("provenance") == "basic_default", basic_id)
    return x.select("song_id", "track", "category", "method", "backend", font.alias("soundfont_id"), "provenance")


def conflicts(stems: DataFrame, recipe: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stems whose recipe is missing, of an unknown category, or differs from the category's spec.

    wanted (category, method, fallback) is a fixed list of ten categories.
    """
    x = stems.select("song_id", "track", F.col("category").alias("own")).join(recipe.select("song_id", "track", "category", "method", "fallback"), ["song_id", "track"], "left")
    x = x.withColumn("category", F.coalesce("category", "own")).drop("own")
    w = wanted.select("category", F.col("method").alias("want_method"), F.col("fallback").alias("want_fallback"))
    x = x.join(w, "category", "left")
    same = F.col("method").eqNullSafe(F.col("want_method")) & F.col("fallback").eqNullSafe(F.col("want_fallback"))
    why = F.when(F.col("want_method").isNull(), "unknown_category").when(F.col("method").isNull(), "missing").when(~same, "differs")
    return x.withColumn("conflict", why).filter("conflict is not null").select("song_id", "track", "category", "conflict")
