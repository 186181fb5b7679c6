"""Balanced packing of songs into chunks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(sizes: DataFrame, chunks: int, frozen: DataFrame | None = None) -> DataFrame:
    """(song_id, chunk): longest first into the least loaded chunk, ties to the lowest number.

    The greedy order is sequential by definition, so one task streams the sorted (bytes, song_id) pairs,
    a few bytes a song, past a heap of the chunks' loads: sorting spills to disk, and memory holds one
    batch, at every size. Frozen songs stay where they are and weigh from the start.
    """
    import pandas as pd

    free = sizes if frozen is None else sizes.join(frozen.select("song_id"), "song_id", "left_anti")
    n = chunks if frozen is not None else min(chunks, max(1, free.limit(chunks).count()))
    loads = {}
    if frozen is not None:
        rows = frozen.join(sizes, "song_id").groupBy("chunk").agg(F.sum("bytes").alias("b")).collect()  # a row a chunk
        loads = {r["chunk"]: int(r["b"]) for r in rows}

    def greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heap = [(loads.get(k, 0), k) for k in range(n)]
        heapq.heapify(heap)
        for pdf in batches:
            out = []
            for b in pdf["bytes"]:
                load, k = heap[0]
                out.append(k)
                heapq.heapreplace(heap, (load + int(b), k))
            yield pd.DataFrame({"song_id": pdf["song_id"], "chunk": out})

    one = free.select("song_id", "bytes").repartition(1).sortWithinPartitions(F.desc("bytes"), F.asc("song_id"))
    packed = one.mapInPandas(greedy, f"song_id {dict(sizes.dtypes)['song_id']}, chunk int")
    return packed if frozen is None else frozen.select("song_id", "chunk").unionByName(packed)
