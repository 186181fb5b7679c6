"""Deterministic samples, splits, slices and running cut-offs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemloom.functions import exprs as X
from stemloom.session import checkpointed


def first_n(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """N rows in the seeded order. The seeded hash stands for a shuffle and is the same everywhere."""
    return df.orderBy(X.seeded_order(seed, *[F.col(k) for k in key]), *key).limit(n)


def stratified(df: DataFrame, stratum: Column, sizes: dict[str, int], seed: int, key: str) -> DataFrame:
    """Exactly n rows of each stratum in the seeded order; each stratum is one top-n, never a sort of all rows."""
    out = None
    for name, n in sizes.items():
        part = first_n(df.filter(stratum == name), n, seed, key).withColumn("stratum", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def ranked(df: DataFrame, seed: int, key: str, pieces: int = 256) -> DataFrame:
    """df with place (from 1) in the seeded order and n, the number of rows.

    The seeded hash is uniform, so its first two digits cut the order into even pieces; rows are numbered
    within pieces and pieces by their counts.
    """
    x = df.withColumn("_h", X.seeded_order(seed, F.col(key))).withColumn("_p", F.substring("_h", 1, 2))
    one = W.partitionBy(F.lit(0))  # 256 pieces
    p = x.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    p = p.select("_p", F.coalesce(F.sum("_c").over(one.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(one).alias("n"))
    x = x.withColumn("_rn", F.row_number().over(W.partitionBy("_p").orderBy("_h", key)))
    return x.join(F.broadcast(p), "_p").withColumn("place", F.col("_before") + F.col("_rn")).drop("_h", "_p", "_rn", "_before")


def three_way_split(df: DataFrame, key: str, seed: int, val: float = 0.05, test: float = 0.05) -> DataFrame:
    """Val, test and train by seeded order; half-even sizes, at least one each beyond two rows."""
    x = ranked(df, seed, key)

    def size(share: float) -> Column:
        n = F.bround(F.col("n") * share).cast("long")
        return F.when(F.col("n") > 2, F.greatest(n, F.lit(1))).otherwise(n)

    split = F.when(F.col("place") <= size(val), "val").when(F.col("place") <= size(val) + size(test), "test").otherwise("train")
    return x.withColumn("split", split).drop("place", "n")


def shard_slices(df: DataFrame, key: str, seed: int, shards: int) -> DataFrame:
    """Contiguous slices of the seeded order, the remainder to the first ones."""
    x = ranked(df, seed, key)
    size, more = F.floor(F.col("n") / shards), F.col("n") % shards
    edge = more * (size + 1)
    at = F.col("place") - 1
    return x.withColumn("shard", F.when(at < edge, F.floor(at / (size + 1))).otherwise(more + F.floor((at - edge) / F.greatest(size, F.lit(1)))).cast("int")).drop("place", "n")


def hour_matched(df: DataFrame, seconds: str, target_hours: float, seed: int, key: str, pieces: int = 256) -> DataFrame:
    """Rows in the seeded order until their hours reach the target; the crossing row stays, nulls go.

    The running sum goes over the pieces of the hash first, so it needs no sort of all rows in one task.
    """
    x = df.filter(F.col(seconds).isNotNull()).withColumn("_h", X.seeded_order(seed, F.col(key))).withColumn("_p", F.substring("_h", 1, 2))
    one = W.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    p = x.groupBy("_p").agg(F.sum(seconds).alias("_s")).select("_p", F.coalesce(F.sum("_s").over(one), F.lit(0.0)).alias("_before"))
    own = F.sum(seconds).over(W.partitionBy("_p").orderBy("_h", key).rowsBetween(W.unboundedPreceding, -1))
    x = x.join(F.broadcast(p.filter(F.col("_before") < target_hours * 3600)), "_p").withColumn("_run", F.col("_before") + F.coalesce(own, F.lit(0.0)))
    return x.filter((F.col("_run") < target_hours * 3600) | (F.col("_run") == 0)).drop("_h", "_p", "_before", "_run")


def quota_sample(df: DataFrame, song: str, category: str, least: int, most: int, seed: int) -> DataFrame:
    """Songs, in the seeded order, that add to a category still below its quota.

    A song can only count while fewer than `least` stems of one of its categories precede it, so only the
    first songs of each category's order matter: those whose running count before them is below the
    quota. That prefix is at most least songs a category, and one task walks it.
    """
    import pandas as pd

    per = df.groupBy(song, category).agg(F.count(F.lit(1)).alias("k"))
    per = per.withColumn("h", X.seeded_order(seed, F.col(song)))
    # the first `least` of each piece of the order hold the first of the whole, and pieces split a category
    piece = F.substring("h", 1, 2)
    near = per.withColumn("_n", F.row_number().over(W.partitionBy(category, piece).orderBy("h", song))).filter(F.col("_n") <= least)
    need = near.withColumn("_n", F.row_number().over(W.partitionBy(category).orderBy("h", song))).filter(F.col("_n") <= least)
    songs = need.select(song).distinct()
    rows = per.join(songs, song).groupBy(song, "h").agg(F.map_from_entries(F.collect_list(F.struct(category, "k"))).alias("c"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        have: dict[str, int] = {}
        kept = []
        for r in pdf.sort_values(["h", song]).itertuples(index=False):
            counts = dict(r.c)
            if len(kept) < most and any(have.get(c, 0) < least for c in counts):
                kept.append(getattr(r, song))
                for c, n in counts.items():
                    have[c] = have.get(c, 0) + n
        return pd.DataFrame({song: kept})

    return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(walk, f"{song} {dict(df.dtypes)[song]}")


def placed(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with place (from 0) and n, the number of rows, in each group, by the columns of a total order.

    Rows are cut into ranges of (group, order), numbered within each, and ranges by their counts, so no
    group, however large, is sorted in one task.
    """
    x = df.repartitionByRange(group, *order).withColumn("_p", F.spark_partition_id())
    x = checkpointed(x)  # the ranges come from a sample, which a second run would draw again
    counts = x.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_c"))
    own = W.partitionBy(group)
    before = F.coalesce(F.sum("_c").over(own.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(group, "_p", before.alias("_before"), F.sum("_c").over(own).alias("n"))
    x = x.withColumn("_rn", F.row_number().over(W.partitionBy(group, "_p").orderBy(*order)))
    return x.join(counts, [group, "_p"]).withColumn("place", F.col("_before") + F.col("_rn") - 1).drop("_p", "_rn", "_before")


def spaced_examples(df: DataFrame, group: str, song: str, order: list[str], preferred: Column, usable: Column, n: int, candidates: int) -> DataFrame:
    """Up to n rows of each group, k from 0: evenly spaced places of its pool, unusable ones skipped, one a song.

    A group's pool is its preferred rows if there are n of them, else all. `candidates` places from the
    first to the last are looked at, in order.
    """
    x = df.withColumns({"_good": preferred, "_ok": usable})
    enough = x.groupBy(group).agg((F.sum(F.col("_good").cast("int")) >= n).alias("_enough"))
    x = placed(x.join(enough, group).filter(~F.col("_enough") | F.col("_good")), group, order)
    take = F.least(F.lit(candidates), F.col("n")).cast("int")
    at = lambda i: F.when(i == take - 1, F.col("n") - 1).otherwise(F.floor(i * ((F.col("n") - 1) / (take - 1))))
    places = F.when(take == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), take - 1), at))
    x = x.filter(F.array_contains(places, F.col("place")) & F.col("_ok"))
    first = W.partitionBy(group, song).orderBy("place")  # `candidates` rows a group at most from here on
    x = x.withColumn("_first", F.row_number().over(first)).filter("_first = 1")
    x = x.withColumn("k", F.row_number().over(W.partitionBy(group).orderBy("place")) - 1).filter(F.col("k") < n)
    return x.select(*df.columns, F.col("k").cast("int").alias("k"))


def cycled(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of an ordered list (place, ...), from the start again when it ends."""
    size = df.count()
    x = df.sparkSession.range(n).withColumn("place", (F.col("id") % max(size, 1)).cast("int"))
    return x.join(df, "place").orderBy("id")
