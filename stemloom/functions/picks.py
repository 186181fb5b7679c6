"""Seeded choices that come out as Python's own generator makes them, so that picks of earlier runs hold."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from stemloom.functions import exprs as X


def choice_index(seed: Column, n: Column) -> Column:
    """The place, from 0, that a generator with this seed chooses among n; null where there is nothing to choose.

    One place needs no generator. Others seed one each, some ten microseconds: choose once for each
    distinct seed, not for each row.
    """

    @F.pandas_udf("int")
    def chosen(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for seeds, sizes in batches:
            out = [None if pd.isna(s) or pd.isna(k) or k < 1 else random.Random(int(s)).choice(range(int(k))) if k > 1 else 0 for s, k in zip(seeds, sizes, strict=True)]
            yield pd.Series(out, dtype="Int32")

    return F.when(n == 1, 0).when(n > 1, chosen(seed.cast("long"), n.cast("int")))


def pick(options: Column, *parts: Column) -> Column:
    """One of a list by the stable seed of the parts; null where the list is empty."""
    return F.get(options, choice_index(X.stable_seed(*parts), F.size(options)))


def candidates(pools: dict[str, tuple[int, ...]], keys: Column) -> Column:
    """Distinct programs of the pools of some classes, in their order."""
    lists = F.transform(keys, lambda k: F.coalesce(F.try_element_at(_pools(pools), k), F.array().cast("array<int>")))
    return F.array_distinct(F.flatten(lists))


def _pools(pools: dict[str, tuple[int, ...]]) -> Column:
    return F.create_map(*[x for k, v in pools.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def select_patch(program: Column, options: Column, *parts: Column) -> Column:
    """A program of the pool's candidates by the stable seed of the parts; the track's own where there are none."""
    return F.coalesce(pick(options, *parts), program.cast("int"))
