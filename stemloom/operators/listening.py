"""Listening-test ratings and votes: winners, shortlists, cascades, paired scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemloom.functions import exprs as X
from stemloom.functions import values as V


def variant_stats(ratings: DataFrame) -> DataFrame:
    """Means per stem, then per (category, variant); null keys stay groups."""
    s = ratings.groupBy("stem_id", "category", "variant_id").agg(F.avg("content").alias("content"), F.avg("realism").alias("realism"))
    return s.groupBy("category", "variant_id").agg(
        F.avg("content").alias("mean_content"), F.avg("realism").alias("mean_realism"), F.min("content").alias("min_content"), F.countDistinct("stem_id").alias("n_stems")
    )


def _everywhere() -> W:
    return W.partitionBy(F.lit(0))  # one row a (category, variant)


def eligible(stats: DataFrame, least: float = V.CONTENT_THRESHOLD, mean: float = V.CONTENT_MEAN_THRESHOLD) -> DataFrame:
    """Variants that pass; all of them, of all categories, where none passes anywhere."""
    ok = F.coalesce((F.col("min_content") >= least) & (F.col("mean_content") >= mean), F.lit(False))
    x = stats.withColumn("_ok", ok).withColumn("_any", F.max("_ok").over(_everywhere()))
    return x.filter("_ok or not _any").drop("_ok", "_any")


def relative_floor(stats: DataFrame, least: float = V.CONTENT_THRESHOLD, mean: float = V.CONTENT_MEAN_THRESHOLD) -> DataFrame:
    """Content at least max(50, best - 20); else at least the mean threshold; else all."""
    best = F.max("mean_content").over(_everywhere())
    x = stats.withColumn("_a", F.col("mean_content") >= F.greatest(F.lit(float(least)), best - 20)).withColumn("_b", F.col("mean_content") >= mean)
    x = x.withColumn("_any_a", F.max("_a").over(_everywhere())).withColumn("_any_b", F.max("_b").over(_everywhere()))
    return x.filter("_a or (not _any_a and (_b or not _any_b))").drop("_a", "_b", "_any_a", "_any_b")


def auto_winners(stats: DataFrame) -> DataFrame:
    """The best variant of each category by realism, content, then id."""
    w = W.partitionBy("category").orderBy(F.desc_nulls_last("mean_realism"), F.desc_nulls_last("mean_content"), "variant_id")
    return stats.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def gated_winners(stats: DataFrame, least: float) -> DataFrame:
    """The best variant among those that reach the content, or among all of a category where none does."""
    x = stats.withColumn("passed", F.coalesce(F.col("mean_content") >= least, F.lit(False))).withColumn("level", X.noise_level(F.col("variant_id")))
    x = x.withColumn("_any", F.max("passed").over(W.partitionBy("category"))).filter("passed or not _any")
    w = W.partitionBy("category").orderBy(F.desc_nulls_last("mean_realism"), F.desc("level"), F.desc_nulls_last("mean_content"), "variant_id")
    return x.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_any", "level")


def shortlist(stats: DataFrame, realism: float) -> DataFrame:
    """Variants at the realism or above, else the best one, of each category."""
    w = W.partitionBy("category").orderBy(F.desc_nulls_last("mean_realism"), "variant_id")
    x = stats.withColumn("place", F.row_number().over(w)).withColumn("shortlisted", F.coalesce(F.col("mean_realism") >= realism, F.lit(False)))
    x = x.withColumn("_any", F.max("shortlisted").over(W.partitionBy("category")))
    return x.filter("shortlisted or (not _any and place = 1)").select("category", "variant_id", "place", "shortlisted")


def tied_winners(means: DataFrame, key: str, value: str, tol: float = 1e-9) -> DataFrame:
    """All rows within a tolerance of the highest mean of their key."""
    return means.filter(F.col(value).isNotNull()).withColumn("_top", F.max(value).over(W.partitionBy(key))).filter(F.col(value) >= F.col("_top") - tol).drop("_top")


def tier_winners(votes: DataFrame, most: int = 2) -> DataFrame:
    """Variants with a strong accept, else the most weakly accepted ones, of each category."""
    n = lambda t: F.count_if(F.col("tier") == t)
    x = votes.groupBy("category", "variant_id").agg(n("strong_accept").alias("strong"), n("weak_accept").alias("weak"))
    x = x.withColumn("_any", F.max(F.col("strong") > 0).over(W.partitionBy("category")))
    w = W.partitionBy("category").orderBy(F.desc("weak"), "variant_id")
    x = x.withColumn("place", F.row_number().over(w))
    return x.filter((F.col("_any") & (F.col("strong") > 0)) | (~F.col("_any") & (F.col("weak") > 0) & (F.col("place") <= most))).select("category", "variant_id", "strong", "weak")


def cascades(cards: DataFrame, votes: DataFrame) -> DataFrame:
    """Strong rejects go to all cards of the same category and variant, overwriting;
    then strong accepts go to those without a vote. (card_id, category, variant_id, tier, cascaded)."""
    x = cards.join(votes.select("card_id", "tier"), "card_id", "left")
    flags = x.groupBy("category", "variant_id").agg(F.max(F.coalesce(F.col("tier") == "strong_reject", F.lit(False))).alias("reject"), F.max(F.coalesce(F.col("tier") == "strong_accept", F.lit(False))).alias("accept"))
    x = x.join(flags, ["category", "variant_id"])
    new = F.when(F.col("reject"), "strong_reject").when(F.col("tier").isNotNull(), F.col("tier")).when(F.col("accept"), "strong_accept")
    return x.select("card_id", "category", "variant_id", new.alias("tier"), (~new.eqNullSafe(F.col("tier"))).alias("cascaded"))


def without_cross_variant(votes: DataFrame) -> DataFrame:
    """Drop votes that were cascaded from another variant."""
    source = F.split("cascaded_from", r"\|")[0]
    return votes.filter(F.col("cascaded_from").isNull() | (source == F.col("variant_id")))


def condition_stats(ratings: DataFrame, condition: str, metric: str) -> DataFrame:
    """Mean, standard error and n of each condition; means within a listener first."""
    one = ratings.filter(F.col(metric).isNotNull()).groupBy("listener_id", condition).agg(F.avg(metric).alias("m"))
    return one.groupBy(condition).agg(F.avg("m").alias("mean"), F.coalesce(F.stddev_samp("m") / F.sqrt(F.count("m")), F.lit(0.0)).alias("sem"), F.count("m").alias("n"))


def content_difference(ratings: DataFrame, base_of: dict[str, str], order: list[str]) -> DataFrame:
    """A treated condition's content less that of its base, within listener and trial; untreated 0."""
    from .dedupe import keep_first

    base = ratings.filter(~F.col("variant_id").isin(*base_of))
    base = keep_first(base.select("listener_id", "trial_id", "variant_id", "content", *order), ["listener_id", "trial_id", "variant_id"], order)
    base = base.select("listener_id", "trial_id", F.col("variant_id").alias("base_id"), F.col("content").alias("base_content"))
    id_ = F.coalesce(*[F.when(F.col("variant_id") == k, b) for k, b in base_of.items()])
    x = ratings.withColumn("base_id", id_).join(base, ["listener_id", "trial_id", "base_id"], "left")
    diff = F.when(F.col("base_id").isNotNull(), F.col("content") - F.col("base_content")).when(F.col("content").isNotNull(), 0.0)
    return x.withColumn("content_diff", diff).drop("base_content")


def leaderboard(realism: DataFrame, content: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Winners of each category by mean realism, ties included, with the margin to the next.

    Both tables have (category, variant_id, mean).
    """
    x = realism.withColumnRenamed("mean", "realism").join(content.withColumnRenamed("mean", "content"), ["category", "variant_id"], "full_outer").filter("realism is not null")
    x = x.withColumn("best", F.max("realism").over(W.partitionBy("category"))).withColumn("won", F.col("realism") >= F.col("best") - tol)
    g = x.groupBy("category").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("won"), F.col("variant_id")))), ",").alias("winner"),
        F.round(F.max("best"), 6).alias("realism"),
        F.round(F.max(F.when(F.col("won"), F.col("content"))), 6).alias("content"),
        F.round(F.max("best") - F.max(F.when(~F.col("won"), F.col("realism"))), 6).alias("margin"),
    )
    return g


def expand_equivalences(ratings: DataFrame, equivalences: DataFrame) -> DataFrame:
    """Ratings of donor conditions repeated for their duplicates, unless they were rated themselves.

    equivalences (trial_id, duplicate, donor).
    """
    keys = ["listener_id", "trial_id", "variant_id"]
    made = ratings.join(equivalences, (ratings["trial_id"] == equivalences["trial_id"]) & (ratings["variant_id"] == equivalences["donor"])).drop(equivalences["trial_id"])
    made = made.withColumn("source", F.col("variant_id")).withColumn("variant_id", F.col("duplicate")).drop("duplicate", "donor")
    made = made.join(ratings.select(*keys).distinct(), keys, "left_anti").dropDuplicates([*keys, "event_id"])
    return ratings.withColumn("source", F.lit(None).cast("string")).unionByName(made)
