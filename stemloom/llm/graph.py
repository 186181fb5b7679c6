"""Connected components of a graph given by its edges, in Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import checkpointed, hub_join, hubs_of


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root): the least node of the component of each node that has an edge.

    `edges` has (u, v) of long; loops and repeats do no harm. Rounds of large star and small star:
    each joins edges with the least neighbour of one end, which is pre-aggregated, and is written to
    the shared checkpoint folder. Rounds grow with the logarithm of the graph. Edges at a hub meet its
    least neighbour in pieces; nothing is collected.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = checkpointed(e)
    state, rows = None, e.count()
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = hub_join(both, least, "u", hubs_of(both, "u", 2 * rows)).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = hub_join(large, least, "u", hubs_of(large, "u", rows))
        e = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = e.unionByName(least.select("u", F.col("m").alias("v")))
        e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        e = checkpointed(e)
        seen = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state, rows = seen, seen[0]
    else:
        raise RuntimeError("the components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
