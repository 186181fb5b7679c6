"""Uniform sharding with exact shard sizes by a hypergeometric communication matrix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import text as T

SEED = 11
SHARDS = 40
#: Least number of blocks of the first permutation. The matrix has blocks x shards entries.
BLOCKS = 64
#: Rows that a hot key has at least.
HOT_LEAST = 1_000
#: Pieces of each shard in the second permutation.
PIECES = 256


def _unit(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(good: Column, bad: Column, draws: Column, u: Column) -> Column:
    """A hypergeometric number from one uniform number: how many of `draws` balls are good.

    Inversion that walks outward from the mode, so the weights follow from their ratios and no
    factorial is needed. The walk goes 9 standard deviations and 20 steps far; what lies beyond has
    less probability than a double can resolve.
    """
    one, none = F.lit(1.0), F.lit(0.0)

    def bounds(p: Column) -> Column:
        g, b, k = p["g"], p["b"], p["k"]
        n = g + b
        low, high = F.greatest(none, k - b), F.least(k, g)
        mode = F.greatest(low, F.least(high, F.floor((k + 1) * (g + 1) / (n + 2)).cast("double")))
        spread = F.sqrt(F.greatest(none, k * g * b * (n - k) / F.greatest(n * n * (n - 1), one)))
        return F.struct(g.alias("g"), (b - k).alias("c"), k.alias("k"), p["u"].alias("u"), low.alias("low"), high.alias("high"), mode.alias("mode"), spread.alias("spread"))

    def drawn(p: Column) -> Column:
        g, c, k, mode = p["g"], p["c"], p["k"], p["mode"]
        reach = F.least(F.greatest(p["high"] - mode, mode - p["low"]), F.ceil(p["spread"] * 9 + 20).cast("double")).cast("int")
        steps = F.when(reach > 0, F.sequence(F.lit(1), reach)).otherwise(F.array().cast("array<int>"))

        def ahead(s: Column, j: Column) -> Column:  # weight of mode + j
            at = mode + j
            return F.when(at > p["high"], none).otherwise(s["right"] * (g - at + 1) * (k - at + 1) / (at * (c + at)))

        def back(s: Column, j: Column) -> Column:  # weight of mode - j
            at = mode - j
            return F.when(at < p["low"], none).otherwise(s["left"] * (at + 1) * (c + at + 1) / ((g - at) * (k - at)))

        def total(s: Column, j: Column) -> Column:
            x = F.struct(ahead(s, j).alias("right"), back(s, j).alias("left"), s["sum"].alias("sum"))
            return _let(x, lambda y: F.struct(y["right"].alias("right"), y["left"].alias("left"), (y["sum"] + y["right"] + y["left"]).alias("sum")))

        def pick(s: Column, j: Column) -> Column:
            x = F.struct(ahead(s, j).alias("right"), back(s, j).alias("left"), s["over"].alias("over"), s["found"].alias("found"))

            def chosen(y: Column) -> Column:
                found = F.when(y["found"].isNotNull(), y["found"]).when(y["over"] < y["right"], mode + j).when(y["over"] < y["right"] + y["left"], mode - j)
                return F.struct(y["right"].alias("right"), y["left"].alias("left"), (y["over"] - y["right"] - y["left"]).alias("over"), found.alias("found"))

            return _let(x, chosen)

        def found(whole: Column) -> Column:
            over = p["u"] * whole - one
            start = F.struct(one.alias("right"), one.alias("left"), over.alias("over"), F.when(over < 0, mode).alias("found"))
            return F.when(over < 0, mode).otherwise(F.coalesce(F.aggregate(steps, start, pick, lambda s: s["found"]), mode))

        whole = F.aggregate(steps, F.struct(one.alias("right"), one.alias("left"), one.alias("sum")), total, lambda s: s["sum"])
        return _let(whole, found)

    p = F.struct(good.cast("double").alias("g"), bad.cast("double").alias("b"), draws.cast("double").alias("k"), u.alias("u"))
    return _let(_let(p, bounds), drawn).cast("long")


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)


def _drawn(columns: Column, draws: Column, key: Column, shards: int) -> Column:
    """A multivariate hypergeometric vector: how many of `draws` fall in each of the columns."""

    def step(s: Column, i: Column) -> Column:
        good = F.element_at(columns, i)
        x = hypergeometric(good, s["pool"] - good, s["draws"], _unit(key, i))
        return _let(x, lambda v: F.struct(F.concat(s["out"], F.array(v)).alias("out"), (s["draws"] - v).alias("draws"), (s["pool"] - good).alias("pool")))

    start = F.struct(F.array().cast("array<bigint>").alias("out"), draws.cast("long").alias("draws"), _total(columns).alias("pool"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["out"])


def communication_matrix(counts: DataFrame, blocks: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(block, ends): the exact counts that each block sends to each shard, as running ends.

    `counts` has (block, n) for the blocks that have rows. The rows of the matrix sum to the blocks'
    counts, the columns to shard sizes at most one apart, and the law is that of a uniform shuffle of
    all rows. Blocks are halved again and again; each half's column sums are one multivariate
    hypergeometric draw from those of the whole. All of it is blocks x shards numbers.
    """
    if blocks & (blocks - 1):
        raise ValueError("the number of blocks must be a power of two")
    by_block = F.map_from_entries(F.collect_list(F.struct(F.col("block").cast("int"), F.col("n").cast("long"))))
    x = counts.agg(by_block.alias("m")).select(
        F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("n")
    )
    x = x.withColumn("all", _total(F.col("n")))
    share = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.floor(F.col("all") / shards).cast("long") + F.when(i < F.col("all") % shards, 1).otherwise(0))
    x = x.select(F.lit(0).alias("block"), "n", share.alias("to"))
    width = blocks
    while width > 1:
        width //= 2
        left = F.slice("n", 1, width)
        x = x.withColumn("mine", _drawn(F.col("to"), _total(left), F.xxhash64(F.lit(seed), F.lit(width), F.col("block")), shards))
        a = F.struct(F.col("block").alias("block"), left.alias("n"), F.col("mine").alias("to"))
        b = F.struct((F.col("block") + width).alias("block"), F.slice("n", width + 1, width).alias("n"), F.zip_with("to", "mine", lambda p, q: p - q).alias("to"))
        x = x.select(F.inline(F.array(a, b)))
        if blocks // width == 8:
            x = x.repartition(8, "block")  # the lower levels have most of the draws
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda i: _total(F.slice("to", F.lit(1), i)))
    return x.select("block", ends.alias("ends"))


def shard(docs: DataFrame, key: list[Column], shards: int = SHARDS, blocks: int | None = None, seed: int = SEED) -> DataFrame:
    """(row, shard, slot) for each row of docs, by law `rows`: shard sizes at most one apart.

    Rows are dealt to blocks by a hash of `key`, permuted there, cut by the block's row of the
    matrix, exchanged to their shards and permuted again; slots run from 0 without a gap. Rows with
    equal keys are told apart by their number among their equals, so copies spread like other rows; rows of a key with more than a 500th of all rows are told apart by
    their place in the input first, which must come from files or a checkpoint, so that it stays the same.
    Each shard's second permutation runs in PIECES pieces, so no task holds a whole shard.

    `blocks` is a power of two; unset, it is the first one from 64 on that is not below the session's
    shuffle partitions, so blocks stay as small as other tasks.

    Nulls are ordinary key values; an empty table gives an empty result; all columns travel in `row`.
    """
    if blocks is None:
        blocks = max(BLOCKS, 1 << (int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    x = docs.select(T.packed(docs), T.row_hash(docs).alias("rh"), F.xxhash64(F.lit(seed), *key).alias("kh"))
    # rows of a key that is hot are dealt by their place in the input, or one block would hold them all
    keys = docs.select(F.xxhash64(F.lit(seed), *key).alias("kh"))
    hot = keys.groupBy("kh").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(keys.count() / T.HUBS, HOT_LEAST)).select("kh", F.lit(True).alias("hot"))
    x = x.join(F.broadcast(hot), "kh", "left")  # fewer than T.HUBS rows
    part = F.pmod(F.monotonically_increasing_id(), F.lit(blocks * 16))
    x = x.withColumn("kh", F.when(F.col("hot"), F.xxhash64("kh", part)).otherwise(F.col("kh"))).drop("hot")
    x = x.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("kh")), F.lit(blocks)).cast("int"))
    matrix = communication_matrix(x.groupBy("block").agg(F.count(F.lit(1)).alias("n")), blocks, shards, seed)
    x = x.withColumn("occ", F.row_number().over(W.partitionBy("block", "kh").orderBy("rh")))
    x = x.withColumn("r1", F.xxhash64(F.lit(seed + 2), F.col("kh"), F.col("occ")))
    x = x.withColumn("at", F.row_number().over(W.partitionBy("block").orderBy("r1")))
    # blocks x shards numbers, whatever the input: small enough to send everywhere
    x = x.join(F.broadcast(matrix), "block")
    x = x.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("at"))).cast("int"))
    x = x.withColumn("r2", F.xxhash64(F.lit(seed + 3), F.col("r1")))
    x = x.withColumn("piece", F.pmod(F.xxhash64(F.lit(seed + 4), F.col("r2")), F.lit(PIECES)).cast("int"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = x.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n")).select("shard", "piece", before.alias("before"))
    x = x.select("row", "shard", "piece", F.row_number().over(W.partitionBy("shard", "piece").orderBy("r2")).alias("rn"))
    x = x.join(F.broadcast(starts), ["shard", "piece"])  # shards x PIECES rows at most
    return x.select("row", "shard", (F.col("before") + F.col("rn") - 1).cast("long").alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = T.documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("th"),
    )
    x = shard(docs, [F.col("doc_id"), F.col("th")])
    null = F.lit(None).cast("int").alias("grown_shard")
    return x.select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", null)
