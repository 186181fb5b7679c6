"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import text as T

#: Masks: positions marked 1 are hashed, those marked 0 are ignored. Of all ways to change a fifth of an overlap
#: of 13 to 19 tokens none escapes all of them; of 20 tokens with 4 changes fewer than 1 in 1,000.
MASKS = ("110110011", "111010101", "101101101", "110011101", "11100001011")
#: An overlap counts from this many tokens on, or a whole item that is shorter.
LEAST_TOKENS = 13
#: Items under so many tokens must occur whole.
SHORT = 9
#: Share of the tokens of an overlap that must be equal, as a fraction, so that no rounding decides.
SHARE = (4, 5)
#: Seeds of test items that one pass over the documents carries to every task. A larger benchmark
#: takes more passes, one for each block of its items.
BLOCK_SEEDS = 1_000_000
_TOKENS = re.compile(r"\w+")


def _hash(token: str) -> bytes:
    return xxhash.xxh64_intdigest(token).to_bytes(8, "little")


@cache
def _memo() -> T.Memo:
    """Words to the hashes of their tokens: runs of letters, digits and _, in lower case."""
    return T.Memo(lambda words: [b"".join(map(_hash, _TOKENS.findall(w.lower()))) for w in words])


@cache
def _constants(n: int) -> np.ndarray:
    return np.random.default_rng(9).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the marked tokens at each place where the mask fits; a place before it has none."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k, c in zip([k for k, m in enumerate(mask) if m == "1"], _constants(mask.count("1")), strict=True):
        h += tokens[k : k + n] * c
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(33))


def _progressions(h: np.ndarray, place: np.ndarray, item: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, times, step): rows of equal hashes (and items) at evenly spaced places, as in periodic texts.

    Rows are sorted by hash, item and place. Four evenly spaced ones or more are one progression, each
    other row is one by itself; a row may end one and begin another.
    """
    if not len(h):
        return (np.empty(0, np.int64),) * 3
    alike = h[1:] == h[:-1]
    if item is not None:
        alike &= item[1:] == item[:-1]
    links, gap = np.flatnonzero(alike), np.diff(place)
    new = np.ones(len(links), bool)
    new[1:] = (np.diff(links) != 1) | (gap[links[1:]] != gap[links[:-1]])
    begin = np.flatnonzero(new)
    size = np.diff(begin, append=len(links))
    long = size >= 3
    first, times = links[begin[long]], size[long] + 1
    covered = np.zeros(len(h) + 1, np.int64)
    np.add.at(covered, first, 1)
    np.add.at(covered, first + times, -1)
    alone = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
    step = np.append(gap[first], np.zeros(len(alone), np.int64))
    first, times = np.append(first, alone), np.append(times, np.ones(len(alone), np.int64))
    order = np.argsort(first, kind="stable")
    return first[order], times[order], step[order]


class Seeds:
    """The seeds of a block of test items, sorted, with a bit table that answers most lookups.

    Equal seeds at evenly spaced places, as in a periodic text, are one progression. Items too short for
    the masks to catch every change they may have are cut in three parts, of which one is whole where
    two tokens at most are changed.
    """

    def __init__(self, items: list[np.ndarray]):
        self.items = items
        self.tables = []
        seeds = [(mask, [(k, seed_hashes(x, mask), 0) for k, x in enumerate(items)]) for mask in MASKS]
        thirds: dict[int, list] = {}
        for k, x in enumerate(items):
            if SHORT <= len(x) < LEAST_TOKENS:
                for p in (0, len(x) // 3, len(x) // 3 * 2):
                    thirds.setdefault(len(x) // 3, []).append((k, seed_hashes(x[p : p + len(x) // 3], "1" * (len(x) // 3)), p))
        for mask, own in [*seeds, *(("1" * n, own) for n, own in thirds.items())]:
            h = np.concatenate([*[x for _, x, _ in own], np.empty(0, np.uint64)])
            item = np.repeat(np.array([k for k, _, _ in own], np.int64), [len(x) for _, x, _ in own])
            place = np.concatenate([*[np.arange(p, p + len(x)) for _, x, p in own], np.empty(0, np.int64)])
            order = np.lexsort((place, item, h))
            h, item, place = h[order], item[order], place[order]
            first, times, step = _progressions(h, place, item)
            bits = max(16, int(len(first) * 16).bit_length())
            maybe = np.zeros(1 << bits, bool)
            maybe[(h >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.tables.append((mask, h[first], item[first], place[first], times, step, maybe, np.uint64(64 - bits)))
        #: Items under SHORT tokens: compared whole, by their first token.
        self.short: dict[int, list[int]] = {}
        for k, x in enumerate(items):
            if 0 < len(x) < SHORT:
                self.short.setdefault(int(x[0]), []).append(k)

    def screened(self, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which documents have a seed, or the first token of a short item; text k has tokens[starts[k]:starts[k + 1]].

        All of them are looked up together, so a document without any costs no calls of its own.
        """
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        found = np.zeros(len(starts) - 1, bool)
        for mask, h, *_, maybe, shift in self.tables:
            mine = seed_hashes(tokens, mask)
            at = np.flatnonzero(maybe[(mine >> shift).astype(np.int64)])
            at = at[owner[at] == owner[at + len(mask) - 1]]
            near = np.searchsorted(h, mine[at])
            on = near < len(h)
            found[owner[at[on][h[near[on]] == mine[at[on]]]]] = True
        if self.short:
            found[owner[np.isin(tokens, np.fromiter(self.short, np.uint64, len(self.short)))]] = True
        return found

    def hits(self, tokens: np.ndarray, most: int = 1_000_000) -> np.ndarray:
        """Rows (item, place of the item's first token among the tokens) of all seed matches, each once.

        Progressions of the document meet those of the items that have their hash; two give the shifts
        of one more progression, not the product of their places. No more than `most` pairs or shifts
        are written out at a time.
        """
        longest = max(map(len, self.items), default=0)
        span = len(tokens) + longest + 1
        found = np.empty(0, np.int64)
        for mask, h, item, place, times, step, maybe, shift in self.tables:
            mine = seed_hashes(tokens, mask)
            at = np.flatnonzero(maybe[(mine >> shift).astype(np.int64)])
            if not len(at):
                continue
            at = at[np.lexsort((at, mine[at]))]
            start, n, d = _progressions(mine[at], at)
            p = at[start]
            first, last = np.searchsorted(h, mine[p], "left"), np.searchsorted(h, mine[p], "right")
            ends = np.cumsum(last - first)
            for begin in range(0, int(ends[-1]), most):
                pair = np.arange(begin, min(int(ends[-1]), begin + most))
                own = np.searchsorted(ends, pair, "right")
                run = last[own] - (ends[own] - pair)
                for k, low, by, width in self._shifts(p[own], n[own], d[own], place[run], times[run], step[run], most):
                    key = item[run[k]] * span + longest
                    shifts = np.repeat(key + low, width) + np.repeat(by, width) * (np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width))
                    found = np.union1d(found, shifts)
        return np.column_stack([found // span, found % span - longest])

    @staticmethod
    def _shifts(p: np.ndarray, n: np.ndarray, d: np.ndarray, q: np.ndarray, m: np.ndarray, e: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(pair, lowest shift, step, number of shifts): what each pair of progressions covers, in portions."""
        one = (d == e) | (n == 1) | (m == 1)
        each = np.where(one, 1, np.minimum(n, m))  # of two with unlike steps, the shorter is taken place by place
        width = np.where(one, n + m - 1, np.maximum(n, m))
        cuts = np.cumsum(width * each) // most
        for c in np.unique(cuts):
            some = np.flatnonzero(cuts == c)
            k = np.repeat(some, each[some])
            j = np.arange(len(k)) - np.repeat(np.cumsum(each[some]) - each[some], each[some])
            by_item = one[k] | (n[k] <= m[k])
            low = np.where(by_item, p[k] + j * d[k] - q[k] - (m[k] - 1) * e[k], p[k] - q[k] - j * e[k])
            by = np.where(one[k], np.maximum(d[k], e[k]), np.where(by_item, e[k], d[k]))
            size = width[k]
            parts = np.cumsum(size) // most
            for part in np.unique(parts):
                x = np.flatnonzero(parts == part)
                yield k[x], low[x], by[x], size[x]

    def short_hits(self, tokens: np.ndarray) -> Iterator[tuple[int, int]]:
        if self.short:
            for p in np.flatnonzero(np.isin(tokens, np.fromiter(self.short, np.uint64, len(self.short)))):
                for k in self.short[int(tokens[p])]:
                    yield k, int(p)


def _best_stretch(at: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """(first, tokens, equal tokens): the longest stretch that begins and ends with equal tokens and has the share.

    `at` has the places of the equal tokens, ascending. A stretch from place a to place b has the share
    if 5 times its equal tokens are at least 4 times its tokens; written as one number for each end, that
    is a pair of ends in the right order of their numbers. The farthest end for each start falls out of a
    running maximum from the right, found by bisection: no more memory than the places take.
    """
    if SHARE[1] * len(at) < SHARE[0] * least:
        return None
    tokens = int(at[-1] - at[0]) + 1
    if SHARE[1] * len(at) >= SHARE[0] * tokens:  # all of it
        return (int(at[0]), tokens, len(at)) if tokens >= least else None
    k = np.arange(len(at))
    start, end = SHARE[1] * k - SHARE[0] * at, SHARE[1] * (k + 1) - SHARE[0] * (at + 1)
    best = np.maximum.accumulate(end[::-1])[::-1]  # falls from left to right
    last = np.searchsorted(-best, -start, "right") - 1  # the last end from which on some number is as large
    last = np.maximum(last, -1)
    ok = last >= k
    tokens = np.where(ok, at[last] - at + 1, 0)
    first = int(np.argmax(tokens))
    if tokens[first] < least:
        return None
    return int(at[first]), int(tokens[first]), int(last[first] - first + 1)


def overlaps(tokens: np.ndarray, seeds: Seeds) -> Iterator[tuple[int, int, int, int]]:
    """(item, first token of the document, tokens, equal tokens) of each verified overlap."""
    for item, offset in seeds.hits(tokens).tolist():
        x = seeds.items[item]
        lo, hi = max(0, -offset), min(len(x), len(tokens) - offset)
        equal = x[lo:hi] == tokens[offset + lo : offset + hi]
        if equal.all():
            if hi - lo >= min(LEAST_TOKENS, len(x)):
                yield item, offset + lo, hi - lo, hi - lo
            continue
        equal = np.flatnonzero(equal)
        if found := _best_stretch(equal, min(LEAST_TOKENS, len(x))):
            yield item, offset + lo + found[0], found[1], found[2]
    for item, offset in seeds.short_hits(tokens):
        x = seeds.items[item]
        if len(tokens) - offset >= len(x) and (tokens[offset : offset + len(x)] == x).all():
            yield item, offset, len(x), len(x)


def _broadcast_blocks(benchmark: DataFrame) -> Iterator[tuple[list[Row], Broadcast]]:
    """The test items in blocks of BLOCK_SEEDS seeds at most, and each block's seeds for every task."""
    texts = benchmark.select(F.col("`item_id`").alias("item_id"), F.col("`text`").alias("text")).filter("text is not null")
    weight = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-int(weight) // (BLOCK_SEEDS * 2)) or 1  # a token has two bytes at least, with its gap
    for k in range(n):
        rows = texts.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        memo = _memo()
        items = []
        for _, x in T.coded(pa.array([r.text for r in rows], pa.string())):
            tokens, starts = x.values(memo, "<u8")
            items += [tokens[a:z] for a, z in pairwise(starts.tolist())]
        yield rows, benchmark.sparkSession.sparkContext.broadcast(Seeds(items))


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, item_id, first_token, n_tokens, n_equal): each overlap of a document with a test item.

    Tokens are runs of letters, digits and _, in lower case. A document and an item overlap where, at
    one shift, a stretch of LEAST_TOKENS tokens or more (a whole item, if that is shorter) has a share
    of four fifths of equal tokens. Candidates are shifts at which one of the spaced seeds agrees, so
    a substitution spoils only the seeds that mark its place. Items under nine tokens must occur whole.

    The test items' seeds go to every task, in blocks of a fixed size; documents are never shuffled.
    Null texts have no tokens and overlap with nothing, nor do items without tokens; repeated rows and
    items are reported each; an empty table gives an empty result; all columns travel in `row`.
    """
    x = docs.select(T.packed(docs), F.col("`text`").alias("text"))
    out = None
    for rows, seeds in _broadcast_blocks(benchmark):
        names = docs.sparkSession.createDataFrame([(k, r.item_id) for k, r in enumerate(rows)], f"item int, item_id {dict(benchmark.dtypes)['item_id']}")
        y = x.select("row", F.explode(_finder(seeds)(F.col("text"))).alias("hit")).select("row", "hit.*")
        y = y.join(F.broadcast(names), "item").drop("item")  # as many rows as the block has items
        out = y if out is None else out.unionByName(y)
    return out.select("row", "item_id", "first_token", "n_tokens", "n_equal")


def _finder(seeds: Broadcast):
    schema = "array<struct<item int, first_token int, n_tokens int, n_equal int>>"

    @F.pandas_udf(schema)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = _memo()
        for batch in batches:
            out = []
            for _, x in chain.from_iterable(map(T.coded, T.pieces(batch))):
                tokens, starts = x.values(memo, "<u8")
                for (a, z), some in zip(pairwise(starts.tolist()), seeds.value.screened(tokens, starts), strict=True):
                    found = overlaps(tokens[a:z], seeds.value) if some else ()
                    out.append([dict(zip(("item", "first_token", "n_tokens", "n_equal"), f, strict=True)) for f in found])
            yield pd.Series(out)

    return hits.asNondeterministic()  # else a filter above runs it again


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap with no test item."""
    for _, seeds in _broadcast_blocks(benchmark):
        docs = docs.filter(F.size(_finder(seeds)(F.col("`text`"))) == 0)
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = find(T.documents(spark, sf_dir).select("doc_id", "text"), T.table(spark, sf_dir, "benchmark"))
    return x.select("row.doc_id", "item_id", "first_token", "n_tokens", "n_equal")
