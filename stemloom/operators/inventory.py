"""Counts, shares, histograms and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemloom.session import checkpointed

PERCENTS = (50.0, 75.0, 90.0, 95.0, 99.0, 99.9)


def counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of each key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, groupings: list[list[str]], keys: list[str]) -> DataFrame:
    """Counts and percentages of several groupings in one pass over the input."""
    x = df.groupingSets([[F.col(c) for c in g] for g in groupings] + [[]], *[F.col(c) for c in keys])
    level = F.grouping_id(*[F.col(c) for c in keys])
    x = x.agg(F.count(F.lit(1)).alias("n"), level.alias("level"))
    top = (1 << len(keys)) - 1
    total = F.max(F.when(F.col("level") == top, F.col("n"))).over(W.partitionBy(F.lit(0)))  # as many rows as groups
    return x.withColumn("pct", F.round(F.col("n") * 100.0 / total, 6)).filter(F.col("level") != top)


def with_dimension(facts: DataFrame, dim: DataFrame, key: str, fill: dict) -> DataFrame:
    """Every member of a dimension, zero where it has no facts. The dimension is a fixed list."""
    return dim.join(facts, key, "left").na.fill(fill)


def dimension(spark, key: str, members: tuple) -> DataFrame:
    kind = "int" if isinstance(members[0], int) else "string"
    return spark.createDataFrame([(k, m) for k, m in enumerate(members)], f"place int, {key} {kind}")


def hours(df: DataFrame, *keys: str) -> DataFrame:
    """Rows, wall and active hours and the active share of each key."""
    x = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("wall_seconds").alias("wall"), F.sum("active_seconds").alias("active"))
    return x.select(*keys, "n", F.round(F.col("wall") / 3600, 6).alias("wall_hours"), F.round(F.col("active") / 3600, 6).alias("active_hours"), F.round(F.when(F.col("wall") > 0, F.col("active") / F.col("wall")).otherwise(0.0), 6).alias("active_frac"))


def top_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n largest counts, ties in the order of the key."""
    return df.orderBy(F.desc("n"), key).limit(n)


def top_n_other(counted: DataFrame, key: str, n: int, keep: Column | None = None, other: str = "Other") -> DataFrame:
    """The n largest, the rest in one bucket; `keep` rows always stay. One row a key is ranked."""
    first = F.when(keep, 0).otherwise(1) if keep is not None else F.lit(0)
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(first, F.desc("n"), key))
    x = counted.withColumn("rank", rank)
    return x.groupBy(F.when(F.col("rank") <= n, F.col(key).cast("string")).otherwise(other).alias("bucket")).agg(F.sum("n").alias("n"))


def compared(a: DataFrame, b: DataFrame, key: str, n: int) -> DataFrame:
    """Shares of two inventories side by side, ranked by the first."""
    total = lambda: F.sum("n").over(W.partitionBy(F.lit(0)))
    sa = a.select(key, F.col("n").alias("n_a"), F.round(F.col("n") / total(), 9).alias("share_a"))
    sb = b.select(key, F.col("n").alias("n_b"), F.round(F.col("n") / total(), 9).alias("share_b"))
    return sa.orderBy(F.desc("n_a"), key).limit(n).join(sb, key, "left").na.fill(0)


def overflow_histogram(df: DataFrame, value: Column, least: int, most: int) -> DataFrame:
    """Counts of whole values from least on, all above most in the last bin, empty bins 0."""
    x = df.select(F.least(value, F.lit(most)).cast("int").alias("bin")).filter(F.col("bin") >= least)
    bins = df.sparkSession.range(least, most + 1).select(F.col("id").cast("int").alias("bin"))
    return with_dimension(counts(x, "bin"), bins, "bin", {"n": 0})


def binned_hours(df: DataFrame, n: Column, seconds: Column, most: int) -> DataFrame:
    """Hours by number of stems, from 2, overflow in the last bin; lengths must be positive."""
    x = df.filter(seconds > 0).select(F.least(n, F.lit(most)).cast("int").alias("bin"), seconds.alias("s")).filter("bin >= 2")
    got = x.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s") / 3600, 6).alias("hours"))
    bins = df.sparkSession.range(2, most + 1).select(F.col("id").cast("int").alias("bin"))
    return with_dimension(got, bins, "bin", {"n": 0, "hours": 0.0})


def edge_histogram(df: DataFrame, value: Column, edges: tuple[float, ...]) -> DataFrame:
    """Counts in half-open bins [a, b) between uneven edges; a range join by a when chain."""
    b = F.when(value.isNull(), None)
    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        b = b.when((value >= lo) & (value < hi), k)
    return counts(df.select(b.alias("bin")).filter("bin is not null"), "bin")


def summary(df: DataFrame, value: str) -> DataFrame:
    """N, median, p95, p99, max and mean."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    x = df.agg(F.count(value).alias("n"), p.alias("p"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    r = lambda c: F.round(c, 6)
    return x.select("n", r(F.col("p")[0]).alias("median"), r(F.col("p")[1]).alias("p95"), r(F.col("p")[2]).alias("p99"), r(F.col("max")).alias("max"), r(F.col("mean")).alias("mean"))


def percentiles(df: DataFrame, value: str) -> DataFrame:
    """Exact, linearly interpolated percentiles in rows."""
    x = df.agg(F.percentile(value, F.array(*[F.lit(p / 100) for p in PERCENTS])).alias("v"))
    x = x.select(F.posexplode("v").alias("k", "v"))
    return x.select(F.element_at(F.array(*map(F.lit, PERCENTS)), F.col("k") + 1).alias("percent"), F.round("v", 6).alias("value"))


def two_level(df: DataFrame, unit: str, by: str, value: str, n: int) -> DataFrame:
    """Per unit the maximum and the first label, then count, median and maximum of each label."""
    u = df.groupBy(unit).agg(F.max(value).alias("v"), F.min(by).alias(by))
    x = u.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("v", 0.5), 6).alias("median"), F.round(F.max("v"), 6).alias("max"))
    return top_n(x, by, n)


def ecdf(df: DataFrame, value: str, pieces: int = 64) -> DataFrame:
    """(value, fraction) with fraction = rank / count, ties by place.

    Equal values share their last place's fraction, so distinct values with running counts hold it all;
    the running count goes over pieces of the value range first, so no task sorts all values.
    """
    c = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    lo_hi = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    x = c.join(F.broadcast(lo_hi))  # one row
    x = x.withColumn("piece", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * pieces)).otherwise(0))
    p = x.groupBy("piece").agg(F.sum("n").alias("pn"))
    one = W.partitionBy(F.lit(0))
    p = p.select("piece", F.coalesce(F.sum("pn").over(one.orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("pn").over(one).alias("all"))
    run = F.sum("n").over(W.partitionBy("piece").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    return x.join(F.broadcast(p), "piece").select("value", "n", F.round((F.col("before") + run) / F.col("all"), 9).alias("fraction"))


def token_counts(df: DataFrame, joined: Column) -> DataFrame:
    """How many rows hold each token of a pipe-joined text."""
    x = df.select(F.explode(F.array_distinct(F.split(joined, r"\|"))).alias("token")).filter("token <> ''")
    return counts(x, "token")


def release_summary(songs: DataFrame, chunks: DataFrame, least: int = 2) -> DataFrame:
    """One row of counts, hours and shares of a release.

    songs (song_id, n_tracks, song_length, bdgp): a song counts its mix's length once, whatever its stems;
    lengths that are missing or not positive count nothing. chunks (chunk, bytes) has a row a stem or file.
    Songs of `least` tracks are multitrack; shares of nothing are 0.
    """
    hours = F.sum(F.when(F.col("song_length") > 0, F.col("song_length"))) / 3600
    many = F.col("n_tracks") >= least
    many_hours = F.sum(F.when(many & (F.col("song_length") > 0), F.col("song_length"))) / 3600
    zero = F.lit(0.0)
    share = lambda part, whole, digits: F.when(whole > 0, F.round(part / whole, digits)).otherwise(zero)
    x = songs.agg(
        F.count(F.lit(1)).alias("songs"), F.sum("n_tracks").alias("stems"), F.round(F.coalesce(hours, zero), 1).alias("hours"),
        F.count_if(many).alias("multitrack_songs"), F.round(F.coalesce(many_hours, zero), 1).alias("multitrack_hours"),
        share(F.count_if(many), F.count(F.lit(1)), 4).alias("multitrack_song_share"), share(F.coalesce(many_hours, zero), F.coalesce(hours, zero), 4).alias("multitrack_hour_share"),
        F.round(F.avg("n_tracks"), 6).alias("mean_stems"), F.percentile("n_tracks", 0.5).alias("median_stems"), F.max("n_tracks").alias("most_stems"), F.count_if("bdgp").alias("bdgp_songs"),
    )
    c = chunks.groupBy("chunk").agg(F.sum("bytes").alias("b")).agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("b") / 1024**3, 6).alias("chunk_gib"))
    return x.join(F.broadcast(c))  # one row each


#: Distinct values in a piece of a key, and most pieces of one.
PIECE, PIECES = 4096, 4096


def bootstrap_ci(df: DataFrame, key: str, value: str, n_boot: int = 1000, alpha: float = 0.05, seed: int = 43, piece: int = PIECE) -> DataFrame:
    """(key, n, mean, low, high): mean and percentile interval of resampled means of each key.

    Resampling rows draws how often each distinct value comes, which is a multinomial over their counts.
    That is drawn in two steps: how many rows of each replicate come from each piece of a key's values,
    then, in a task for each piece, which values those are; the pieces' sums are added. The law is that
    of one draw over all values, and no task holds a key. Null and non-finite values are dropped.
    """
    import zlib

    import numpy as np
    import pandas as pd

    kind = dict(df.dtypes)[key]
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    x = df.filter(finite).groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    x = checkpointed(x)
    pieces = x.groupBy(key).agg(F.least(F.lit(PIECES), F.ceil(F.count(F.lit(1)) / piece)).cast("int").alias("pieces"))
    x = x.join(pieces, key).withColumn("piece", F.pmod(F.xxhash64("v"), F.col("pieces")).cast("int")).drop("pieces")
    totals = x.groupBy(key, "piece").agg(F.sum("n").alias("n"))

    def generator(key_value, *more: int):
        return np.random.default_rng([seed, zlib.crc32(repr(key_value).encode()), *more])

    def shares(key_values: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece")
        n = pdf["n"].to_numpy(np.int64)
        drawn = generator(key_values[0]).multinomial(n.sum(), n / n.sum(), n_boot)
        return pd.DataFrame({key: key_values[0], "piece": pdf["piece"], "drawn": list(drawn.T)})

    def sums(key_values: tuple, values: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        values = values.sort_values("v")
        v, n = values["v"].to_numpy(float), values["n"].to_numpy(np.int64)
        rng, out = generator(key_values[0], int(key_values[1]) + 1), np.empty(n_boot)
        times = np.asarray(drawn["drawn"].iloc[0])
        for k in range(0, n_boot, 50):
            out[k : k + 50] = rng.multinomial(times[k : k + 50], n / n.sum()) @ v
        return pd.DataFrame({key: key_values[0], "boot": np.arange(n_boot), "total": out})

    draws = totals.groupBy(key).applyInPandas(shares, f"{key} {kind}, piece int, drawn array<bigint>")
    parts = x.groupBy(key, "piece").cogroup(draws.groupBy(key, "piece")).applyInPandas(sums, f"{key} {kind}, boot int, total double")
    whole = x.groupBy(key).agg(F.sum("n").alias("n"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    means = parts.groupBy(key, "boot").agg(F.sum("total").alias("total")).join(whole, key)
    ends = F.percentile(F.col("total") / F.col("n"), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    x = means.groupBy(key).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), ends.alias("e"))
    return x.select(key, "n", "mean", F.col("e")[0].alias("low"), F.col("e")[1].alias("high"))
