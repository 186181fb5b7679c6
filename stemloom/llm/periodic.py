"""Periodic runs of words: repeated k-grams mask what cannot repeat, Main and Lorentz find the runs in the rest."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import text as T

#: A run has at least LEAST words and COPIES periods.
LEAST, COPIES = 6, 4
#: Pairs of places that are compared at a time; bounds a task's memory, not its results.
PAIRS = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
RUNS = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
RUN_TYPE = S.ArrayType(S.StructType([S.StructField(n, S.LongType()) for n in ("start", "length", "period")]))


def overlap(least: int = LEAST, copies: int = COPIES) -> int:
    """Words that a run of any period has, at least, in common with itself moved by one period."""
    return min(max(least, copies * q) - q for q in range(1, least + 1))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 random-looking bits of each number."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def segments(codes: np.ndarray, starts: np.ndarray, k: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(lo, hi): the stretches of words that lie in k-grams which their document has twice or more.

    A run of period q shares k words or more with itself moved by q, so each of its words lies in such
    a k-gram. K-grams are compared by hashes; equal hashes of different ones only leave more words.
    """
    n = len(codes)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    if n < least:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    mixed, grams = _mixed(codes), np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        grams = grams * _BASE + mixed[j : n - k + 1 + j]
    at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    grams = (grams[at] ^ _mixed(doc[at])) * _BASE
    order = np.argsort(grams)
    same = grams[order[1:]] == grams[order[:-1]]
    twice = np.union1d(at[order[1:][same]], at[order[:-1][same]])
    step = np.zeros(n + 1, np.int64)
    step[twice] += 1
    step[twice + k] -= 1
    inside = np.cumsum(step[:n]) > 0
    lo = np.flatnonzero(inside & ~np.append(False, inside[:-1] & (doc[1:] == doc[:-1])))
    hi = np.flatnonzero(inside & ~np.append(inside[1:] & (doc[1:] == doc[:-1]), False)) + 1
    long = hi - lo >= least
    return lo[long], hi[long]


class _Prefixes:
    """Whether stretches of words are equal, by polynomial prefix hashes."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.power = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, _BASE)))
        self.sums = np.append(np.uint64(0), np.cumsum(_mixed(codes) * self.power[:n]))

    def equal(self, i: np.ndarray, p: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of words i to i + size and those p further on."""
        s = self.sums
        return (s[i + size] - s[i]) * self.power[p] == s[i + p + size] - s[i + p]

    def common(self, i: np.ndarray, p: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How far the words from i on, or back from i, equal those p further on; `most` at most."""
        size = np.zeros(len(i), np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step := step >> 1:
            longer = size + step
            fits = np.flatnonzero(longer <= most)
            at, length = i[fits], longer[fits]
            size[fits[self.equal(at - length if back else at, p[fits], length)]] += step
        return size


def _crossing(codes: np.ndarray, h: _Prefixes, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray, copies: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, end, period, place) of the stretches with `copies` periods that cross the middle of a node [lo, hi).

    Such a stretch has two periods or more on one side of the middle: a square that starts there or ends
    there. Stretches reach as far as their segment [first, last).
    """
    ends = np.cumsum((hi - lo) // copies)
    total = int(ends[-1]) if len(ends) else 0
    for begin in range(0, total, PAIRS):
        pair = np.arange(begin, min(total, begin + PAIRS))
        node = np.searchsorted(ends, pair, "right")
        p = pair - np.append(0, ends[:-1])[node] + 1
        mid = ((lo + hi) // 2)[node]
        for at, ok in ((mid, mid + 2 * p <= hi[node]), (mid - 2 * p, mid - 2 * p >= lo[node])):
            k = np.flatnonzero(ok)
            k = k[codes[at[k]] == codes[at[k] + p[k]]]
            k = k[h.equal(at[k], p[k], p[k])]
            i, q, seg = at[k], p[k], node[k]
            left = h.common(i, q, i - first[seg], True)
            right = h.common(i + q, q, last[seg] - i - 2 * q, False)
            yield i - left, i + 2 * q + right, q, i


def runs_of(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int = LEAST, copies: int = COPIES) -> np.ndarray:
    """Rows (start, end, period): the runs within segments, by divide and conquer over all segments at a time.

    A run that crosses no middle lies in one half. Several periods may give one stretch; the smallest is
    its period. Hashes propose, the words themselves confirm each run.
    """
    h, found, first, last = _Prefixes(codes), [np.empty((0, 4), np.int64)], lo, hi
    while len(lo):
        for start, end, p, at in _crossing(codes, h, lo, hi, first, last, copies):
            keep = end - start >= np.maximum(least, copies * p)
            found.append(np.column_stack([start, end, p, at])[keep])
        mid = (lo + hi) // 2
        lo, hi, first, last = np.append(lo, mid), np.append(mid, hi), np.append(first, first), np.append(last, last)
        big = hi - lo >= least
        lo, hi, first, last = lo[big], hi[big], first[big], last[big]
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.append(True, (np.diff(rows[:, :2], axis=0) != 0).any(1))[: len(rows)]
    best = rows[new]
    wrong = [j for j, (s, e, p, _) in enumerate(best) if not np.array_equal(codes[s : e - p], codes[s + p : e])]
    if wrong:  # two different stretches had one hash: compare words instead
        group = np.cumsum(new) - 1
        again = {_compared(codes, s, e, at, p) for s, e, p, at in rows[np.isin(group, wrong)].tolist()}
        best = np.delete(best, wrong, 0)
        known = {(s, e): p for s, e, p, _ in best.tolist()}
        for s, e, p in sorted(again, reverse=True):
            if e - s >= max(least, copies * p) and p <= known.get((s, e), p):
                known[s, e] = p
        best = np.array(sorted((s, e, p, s) for (s, e), p in known.items()), np.int64).reshape(-1, 4)
    return best[:, :3]


def _compared(codes: np.ndarray, lo: int, hi: int, at: int, p: int) -> tuple[int, int, int]:
    """The stretch of period p around the words at `at` and p further on, within [lo, hi)."""
    unlike = np.flatnonzero(codes[lo : hi - p] != codes[lo + p : hi]) + lo
    k = int(np.searchsorted(unlike, at))
    start = int(unlike[k - 1]) + 1 if k else lo
    return start, (int(unlike[k]) if k < len(unlike) else hi - p) + p, p


def _lists(values: pa.Array, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _collapsed(known: T.Coded, least: int, copies: int) -> tuple[pa.Array, pa.Array]:
    """(runs, text without repetitions) of each text of a portion."""
    codes, starts = known.codes.astype(np.int64), known.starts
    runs = runs_of(codes, *segments(codes, starts, overlap(least, copies), least), least, copies)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    owner = np.searchsorted(starts, runs[:, 0], "right") - 1
    step = np.zeros(len(codes) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 1], -1)
    keep = np.cumsum(step[:-1]) == 0
    columns = [runs[:, 0] - starts[owner], runs[:, 1] - runs[:, 0], runs[:, 2]]
    spans = _lists(pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(RUNS.value_type)), np.searchsorted(owner, np.arange(len(starts))))
    words = _lists(known.words.take(pa.array(codes[keep])), np.append(0, np.cumsum(keep))[starts])
    return spans, pc.binary_join(words, " ")


def collapse(docs: DataFrame, least: int = LEAST, copies: int = COPIES, keep: list[str] | None = None) -> DataFrame:
    """(row, runs, text) of each row of docs: its periodic runs of words, and its text without the repetitions.

    A run is a stretch of words with smallest period q, of `least` words and `copies` * q at least, that
    no word beside it extends. The text keeps each word that no run contains after the run's first q
    words, joined by one space.

    Each text is worked on where it is read, in portions of some 1 MB or one text; nothing is shuffled.
    Time is n log^2 n, memory linear in a text. Null and empty texts, and those without a word, have no
    runs and the text ''; repeated rows are treated alike, each; an empty table gives an empty result;
    `keep` names the columns that travel in `row` (all), whatever their names.
    """
    x = docs.select(T.packed(docs.select(*[F.col(f"`{c}`") for c in keep]) if keep else docs), F.col("`text`").cast("string").alias("text"))
    schema = S.StructType([x.schema["row"], S.StructField("runs", RUN_TYPE), S.StructField("text", S.StringType())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, known in T.coded(b.column("text")):
                rows = b.column("row").slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([rows, *_collapsed(known, least, copies)], names=["row", "runs", "text"])

    return x.mapInArrow(work, schema)


def repeating(doc_id: Column, text: Column) -> Column:
    """The contract's texts: those of a tenth of the ids repeat their words from some word on."""
    h = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(1).cast("long"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(T.WORD), F.lit(0))

    def again(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))), " "))

    once = F.get(F.transform(F.array(words), again), 0)  # splits the text once
    return F.when((h % 10 == 0) & text.isNotNull(), F.coalesce(once, text)).otherwise(text)


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.documents(spark, sf_dir).select("doc_id", repeating(F.col("doc_id"), F.col("text")).alias("text"))
    x = collapse(docs, keep=["doc_id"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    x = x.select(F.col("row.doc_id").alias("doc_id"), "runs", "text", best.alias("best"))
    return x.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("text"), 256).alias("collapsed_sha256"),
    )
