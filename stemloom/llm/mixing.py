"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import text as T

SEED = 7
#: Hex digits of a document's hash that split rows of one source and one size: 4096 pieces.
SALT_DIGITS = 3


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _unit(digest: Column) -> Column:
    """20 bits of a digest as a number from 0 up to 1; sums with products of such a grid stay exact."""
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_repeat: int = 3) -> DataFrame:
    """Targets of a table (skey, source, source_size) with one row for each source.

    Sources in code point order, null last, get the weights in turn and share the total size; a
    target stops at `most_repeat` times its source's size and the excess is shared again by weight.
    The fixed point has a closed form: target = min(cap, level x weight) with one level for all, and
    sorted by cap / weight the capped sources are a prefix. Only one row a source comes together.
    """
    everything = W.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sources.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * F.lit(most_repeat))
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    x = x.select(
        "*",
        F.row_number().over(by_ratio).alias("pos"),
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    )
    level = (F.col("total") - F.col("cap_before")) / F.col("weight_left")
    fits = level <= F.col("cap") / F.col("weight")
    x = x.withColumn("level_here", F.when(fits, level)).withColumn("pos_here", F.when(fits, F.col("pos")))
    x = x.withColumn("level", F.min_by("level_here", "pos_here").over(everything))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return x.select("skey", "source", "source_size", target.alias("target"), rate.alias("rate"))


def decide(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_repeat: int = 3, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """How often the mix takes each document: (row, size, source_size, target, copies, taken).

    Systematic sampling: within a source, documents stand in the order (size, hash of doc_id); each
    expects rate = target / source_size copies, the prefix sum of these starts at one random offset a
    source, and a document is emitted once for each whole number its stretch crosses. The order by
    size makes the words taken differ from the target by about one document of the source at most.

    The prefix sum runs in three steps, over sizes of a source, over hash pieces of a size and over
    rows of a piece, so no source and no size, however hot, is ever sorted in one task.

    Null or empty texts have size 0 and are decided like others; null sources form one source; rows
    with equal ids are ordered by their text; an empty table gives an empty result; further columns,
    whatever their names, travel in `row`. `keep` names the columns that do (all): without the text
    among them no text is shuffled.
    """
    text, doc_id, source = F.col("`text`"), F.col("`doc_id`"), F.col("`source`").cast("string")
    x = docs.select(
        T.packed(docs.select(*[F.col(f"`{c}`") for c in keep]) if keep else docs),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("skey"),
        T.n_words(text).alias("size"),
        _digest(doc_id, F.lit(seed)).alias("h"),
        T.row_hash(docs).alias("th"),
    ).withColumn("salt", F.substring("h", 1, SALT_DIGITS))
    if keep and "text" not in keep:
        x = T.checkpointed(x)  # slim rows: each text is read and split once
    pieces = x.groupBy("skey", "size", "salt").agg(F.max("source").alias("source"), F.count(F.lit(1)).alias("n"))
    sizes = pieces.groupBy("skey", "size").agg(F.max("source").alias("source"), F.sum("n").alias("n"))
    sources = sizes.groupBy("skey").agg(F.max("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    aim = targets(sources, weights, most_repeat).drop("source")
    up = W.unboundedPreceding
    sizes = (
        sizes.withColumn("before_size", F.coalesce(F.sum("n").over(W.partitionBy("skey").orderBy("size").rowsBetween(up, -1)), F.lit(0)))
        .join(aim, "skey")
        .select("skey", "size", "before_size", "source_size", "target", "rate")
    )
    before = F.coalesce(F.sum("n").over(W.partitionBy("skey", "size").orderBy("salt").rowsBetween(up, -1)), F.lit(0))
    pieces = pieces.select("skey", "size", "salt", before.alias("before_salt")).join(sizes, ["skey", "size"])
    ranked = x.withColumn("rn", F.row_number().over(W.partitionBy("skey", "size", "salt").orderBy("h", "th")))
    y = ranked.join(pieces, ["skey", "size", "salt"]).withColumn("k", F.col("before_size") + F.col("before_salt") + F.col("rn"))
    start = _unit(_digest(F.col("skey"), F.lit(f"offset{seed}")))
    crossed = (F.floor(start + F.col("rate") * F.col("k")) - F.floor(start + F.col("rate") * (F.col("k") - 1))).cast("int")
    y = y.withColumn("copies", crossed)
    return y.select("row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: each one `copies` times, with the columns of `docs`."""
    y = decide(docs, **options).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return T.unpacked(y, docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.documents(spark, sf_dir).select("doc_id", "source", "text")
    y = decide(docs, keep=["doc_id"])
    return y.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM s),
p AS (SELECT *, row_number() OVER o AS pos, sum(source_size) OVER () AS total,
    coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
l AS (SELECT min_by((total - cap_before)::DOUBLE / weight_left::DOUBLE, pos) AS level FROM p
  WHERE (total - cap_before)::DOUBLE / weight_left::DOUBLE <= cap::DOUBLE / weight),
t AS (SELECT source, source_size, least(cap::DOUBLE, level * weight) AS target,
    CASE WHEN source_size > 0 THEN least(cap::DOUBLE, level * weight) / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5(coalesce('s' || source, 'n') || '|offset7'), 1, 5))::BIGINT / 1048576.0::DOUBLE AS start
  FROM p, l),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, md5(coalesce(doc_id::VARCHAR, '') || '|7')) AS k FROM d),
c AS (SELECT r.doc_id, r.size, t.source_size, t.target,
    (floor(start + rate * k) - floor(start + rate * (k - 1)))::INTEGER AS copies
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM c
"""
