"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemloom.session import checkpointed, removed, shared_folder, table

__all__ = [
    "WORD", "Coded", "Memo", "checkpointed", "coded", "documents", "fresh", "hub_join", "hubs_of", "marked", "marks", "n_words", "packed", "pieces", "removed", "row_hash", "shared_folder", "spread", "table", "unpacked", "words_of", "written",
]

#: A word: what stands between the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
_WORDS = re.compile(WORD)
#: Most keys of a join that count as hot, and the rows that a hot key has at least.
HUBS, HUB_LEAST = 500, 200
#: Pieces of a hot key.
SALTS = 64
#: Cells of 64 bits in a table of marks (a power of two). Fewer let more rows through; no result depends on it.
CELLS = 1 << 18
# Fixed value: characters beyond the ASCII white space at which str.split cuts too.
_MORE_SPACE = [chr(c) for c in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def written(df: DataFrame, stem: str) -> DataFrame:
    """df as a compressed table in the shared folder: like a checkpoint, for many rows of small numbers."""
    path = shared_folder(df.sparkSession, stem)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Number of words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[str]:
    """The words of a text, split at ASCII white space only; null has none."""
    if not text:
        return []
    return _WORDS.findall(text) if any(map(text.__contains__, _MORE_SPACE)) else text.split()


def spread(codes: np.ndarray, size: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, times): the values of each code, one after another; code k has size[k] of them in the table."""
    if len(table) == len(size) and (size == 1).all():
        return table[codes], np.ones(len(codes), np.int64)
    first = np.cumsum(size) - size
    times = size[codes]
    ends = np.cumsum(times)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[codes] - ends + times, times)
    return table[at], times


class Coded:
    """The words of some texts as numbers of their distinct words: text k has codes[starts[k]:starts[k + 1]]."""

    def __init__(self, words: pa.Array, codes: np.ndarray, starts: np.ndarray):
        self.words, self.codes, self.starts = words, codes, starts

    def values(self, memo: Memo, dtype: str) -> tuple[np.ndarray, np.ndarray]:
        """(values, starts): what the memo knows of each word, one after another, and where each text's begin."""
        parts = memo.of(self.words.to_pylist())
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(dtype).itemsize
        return self.spread(size, np.frombuffer(b"".join(parts), dtype))

    def spread(self, size: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, times = spread(self.codes, size, table)
        return values, np.append(0, np.cumsum(times))[self.starts]


@cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not glibc
        return lambda _: 0


def _release() -> None:
    """Give freed memory back to the machine: workers wait between tasks, beside the executor's own memory."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def coded(column: pa.Array, most_bytes: int = 1_000_000) -> Iterator[tuple[slice, Coded]]:
    """The words of a column of texts, portion by portion, each distinct one only once; null has none."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most_bytes)))
        lists = pc.ascii_split_whitespace(pc.fill_null(column.slice(start, stop - start).cast(pa.string()), ""))
        found = lists.flatten().dictionary_encode()
        codes, starts = found.indices.to_numpy(), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64))
        empty = pc.index(found.dictionary, "").as_py()
        if empty >= 0:  # white space at an end of a text
            keep = codes != empty
            codes, starts = codes[keep], np.append(0, np.cumsum(keep))[starts]
        yield slice(start, stop), Coded(found.dictionary, codes, starts)
        start = stop
    _release()


def pieces(batch: pd.Series, rows: int = 1024) -> Iterator[pa.Array]:
    """The texts of a batch, some rows at a time, so that no second copy of the whole batch is held."""
    for start in range(0, len(batch), rows):
        yield pa.array(batch.iloc[start : start + rows].tolist(), pa.string())


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the frame doesn't have, whatever its letters' case."""
    have, name = {c.lower() for c in df.columns}, stem
    while name.lower() in have:
        name += "_"
    return name


def packed(df: DataFrame) -> Column:
    """The whole row as one struct, so that no name of its columns can clash with an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed, to order rows that are else alike."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()], F.lit(1))


def hubs_of(facts: DataFrame, key: str, rows: int) -> DataFrame:
    """(key): the keys with more than a HUBS-th of the `rows` rows of facts, fewer than HUBS in all."""
    return facts.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(rows / HUBS, HUB_LEAST)).select(key)


def hub_join(facts: DataFrame, nodes: DataFrame, key: str, hubs: DataFrame | list, how: str = "inner") -> DataFrame:
    """facts joined by key with nodes, which have one row for each key, without a hot key in any task.

    Each of the hubs, which are fewer than HUBS keys, meets its rows in SALTS pieces. A table of them is
    sent to each task; a list of them stands in the plan, and an empty one leaves a plain join.
    """
    if hubs == []:
        return facts.join(nodes, key, how)
    is_hub, salt = fresh(facts, "is_hub"), fresh(facts, "salt")
    if isinstance(hubs, list):
        mark = lambda x: x.withColumn(is_hub, F.coalesce(F.col(key).isin(hubs), F.lit(False)))
    else:
        table = F.broadcast(hubs.withColumn(is_hub, F.lit(True)))  # fewer than HUBS rows
        mark = lambda x: x.join(table, key, "left")
    mine = F.when(F.col(is_hub), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0)
    each = F.explode(F.when(F.col(is_hub), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    return mark(facts).withColumn(salt, mine).drop(is_hub).join(mark(nodes).withColumn(salt, each).drop(is_hub), [key, salt], how).drop(salt)


def _cell_and_bit(key: str) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    return h.bitwiseAND(F.lit(CELLS - 1)), F.shiftrightunsigned(h, 58).cast("int")


def marks(keys: DataFrame, key: str) -> DataFrame:
    """(cell, bits): a bit set for each key; CELLS rows at most, however many keys there are."""
    cell, bit = _cell_and_bit(key)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    return keys.groupBy(cell.alias("cell")).agg(F.bit_or(one).alias("bits"))


def marked(df: DataFrame, key: str, table: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of df that may have one of the keys of a table of marks; with left_anti those that surely have none.

    The table goes to each task, so that rows of other keys need no shuffle; some of them pass, so a join
    with the keys themselves has to follow.
    """
    cell, bit = _cell_and_bit(key)
    return df.join(F.broadcast(table), (cell == table["cell"]) & (F.getbit(table["bits"], bit) == 1), how)


def unpacked(df: DataFrame, columns: list[str], extra: list[Column] | None = None) -> DataFrame:
    """The columns of a packed row again, and more columns after them."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns], *(extra or []))


class Memo:
    """Words to bytes of a fixed-width code, each distinct word worked out once.

    `make` takes a list of unseen words and returns their bytes. The memory is bounded: past half of
    `most` words the known ones become the old ones, and of those only the words met again stay; that
    changes no result. A Python worker serves one operator after another, so a memo that learns empties
    the one that learned before it. `below` is a memo that `make` itself adds to, emptied together with
    this one.
    """

    latest: Memo | None = None

    def __init__(self, make: Callable[[list[str]], Iterable[bytes]], most: int = 150_000, below: Memo | None = None):
        self.make, self.most, self.below = make, most, below
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def clear(cls) -> None:
        """Empty the memo that an operator before this one left in the worker."""
        if cls.latest is not None:
            cls.latest.forget()
            cls.latest = None

    def learn(self, batches: Iterable[list[str]]) -> None:
        if Memo.latest is not self:
            Memo.clear()
            Memo.latest = self
        self.add(batches)

    def of(self, words: list[str]) -> list[bytes]:
        self.learn([words])
        return [self.known[w] for w in words]

    def forget(self) -> None:
        self.known, self.old = {}, {}
        if self.below:
            self.below.forget()

    def add(self, batches: Iterable[list[str]]) -> None:
        unseen = set().union(*batches)
        todo = unseen.difference(self.known)
        if len(self.known) + len(todo) > self.most // 2:
            self.old, self.known, todo = self.known, {}, unseen
        again = todo.intersection(self.old)
        self.known.update((w, self.old[w]) for w in again)
        if new := list(todo - again):
            self.known.update(zip(new, self.make(new), strict=True))

    def join(self, words: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, words))

    def array(self, words: list[str], dtype: str) -> np.ndarray:
        return np.frombuffer(self.join(words), dtype=dtype)
