"""Keep-last and keep-first over a stated order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _one(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    # the order's columns come first, so the row itself is what is compared, and nothing is carried twice
    best = df.groupBy(*keys).agg(pick(F.struct(*order, *[c for c in rest if c not in order])).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key. An aggregate, so a key's rewrites combine before
    the shuffle and no key, however hot, is sorted in one task. The order must be total within a key."""
    return _one(df, keys, order, F.max)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    return _one(df, keys, order, F.min)
