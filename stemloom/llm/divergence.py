"""How sources differ in their words: a merged sketch rules terms out before any shuffle, survivors are counted exactly."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import text as T

#: Documents of its language that a kept term has at least, and the ranks of terms that are listed.
LEAST, TOP = 30, 50
#: Cells in a row of the sketch (a power of two), and rows. A smaller sketch rules out fewer terms; no result depends on it.
WIDTH, DEPTH = 1 << 22, 3
#: Cells in a block of the sketch; blocks without a count are not sent.
CELLS = 1 << 16
_CODEC = "zstd"
#: Bytes: letters in lower case, those of other characters as they are, a space for all else.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_only(texts: pa.StringArray) -> pa.StringArray:
    """Texts with spaces for what is no ASCII letter or other character beyond ASCII, and A-Z in lower case."""
    valid, offsets, data = texts.buffers()
    turned = pa.py_buffer(data.to_pybytes().translate(_LETTERS)) if data else data
    return pa.StringArray.from_buffers(len(texts), offsets, turned, valid, -1, texts.offset)


class _Portion:
    """The (group, term) counts of a portion of a batch: place of group and term, occurrences and documents."""

    def __init__(self, group: np.ndarray, known: T.Coded):
        size = max(1, len(known.words))
        doc = np.repeat(np.arange(len(known.starts) - 1), np.diff(known.starts))
        in_doc, times = np.unique(doc * size + known.codes, return_counts=True)
        key = group[in_doc // size] * size + in_doc % size
        found, at = np.unique(key, return_inverse=True)
        self.group, self.term = found // size, found % size
        self.n = np.bincount(at, times, len(found)).astype(np.int64)
        self.df = np.bincount(at, minlength=len(found))
        self.words = known.words

    def cells(self, salt: np.ndarray, width: int, depth: int) -> np.ndarray:
        """For each row of the sketch the cells of the (group, term) counts; salt is a hash of each group's key."""
        h = pd.util.hash_array(self.words.to_numpy(zero_copy_only=False), categorize=False)[self.term] if len(self.term) else np.empty(0, np.uint64)
        h = (h ^ salt[self.group]) * np.uint64(0x9E3779B97F4A7C15)
        step = (h >> np.uint64(32)) | np.uint64(1)
        return np.stack([((h ^ (h >> np.uint64(29))) + np.uint64(r) * step) & np.uint64(width - 1) for r in range(depth)]).astype(np.int64)


def _portions(b: pa.RecordBatch, by: list[str]) -> Iterator[tuple[_Portion, list[tuple[str, ...]]]]:
    """The counts of a batch's portions, and the groups that their numbers stand for."""
    coded = [b.column(c).dictionary_encode() for c in by]
    group, names = np.zeros(b.num_rows, np.int64), [()]
    for c in coded:
        group = group * len(c.dictionary) + c.indices.to_numpy(zero_copy_only=False)
        names = [(*x, v) for x in names for v in c.dictionary.to_pylist()]
    used, group = np.unique(group, return_inverse=True)
    names = [names[k] for k in used]
    for part, known in T.coded(terms_only(b.column("text"))):
        yield _Portion(group[part], known), names


def _salts(langs: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(langs, dtype=object), categorize=False) if langs else np.empty(0, np.uint64)


def sketch(docs: DataFrame, least: int = LEAST, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """(row, block, bits): which cells of a count-min sketch of document frequencies reach `least`.

    Each task counts the documents of each (lang, term) into its own sketch; the sketches are added block
    by block. Counters stop at the largest number of their type, which is `least` or more, so a cell never
    has less than the documents of any of its terms, up to `least`.
    """
    kind, cells = (np.uint8 if least < 256 else np.uint32), min(CELLS, width)
    most = np.iinfo(kind).max

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((depth, width), kind)
        for b in batches:
            for portion, names in _portions(b, ["lang"]):
                for r, row in enumerate(portion.cells(_salts([x[0] for x in names]), width, depth)):
                    at, which = np.unique(row, return_inverse=True)
                    more = np.bincount(which, portion.df, len(at)).astype(np.int64)
                    table[r, at] = np.minimum(table[r, at] + more, most)
        for r in range(depth):
            blocks = table[r].reshape(-1, cells)
            used = np.flatnonzero(blocks.any(1))
            packed = [pa.compress(blocks[k].tobytes(), codec=_CODEC, asbytes=True) for k in used]
            yield pa.RecordBatch.from_arrays([pa.array([r] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names=["row", "block", "counts"])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for row, block, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                more = np.frombuffer(pa.decompress(counts, cells * np.dtype(kind).itemsize, codec=_CODEC), kind).astype(np.int64)
                now = total.get((row, block))
                total[row, block] = (more if now is None else np.minimum(now + more, most)).astype(kind)
        rows = [(*k, np.packbits(v >= least).tobytes()) for k, v in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["row", "block", "bits"])

    parts = docs.select("lang", "text").mapInArrow(count, "row int, block int, counts binary")
    return parts.repartition("row", "block").mapInArrow(merge, "row int, block int, bits binary")


def counts(docs: DataFrame, least: int = LEAST, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of terms in each group, exactly.

    Only terms whose cells all reach `least` are counted and shuffled; none with `least` documents of
    its language is missing. The bits of the sketch, depth x width of them, go to each task.
    """
    cells = min(CELLS, width)
    table = np.zeros((depth, width), bool)
    for r in sketch(docs, least, width, depth).toLocalIterator():  # depth x width bits, whatever the input
        table[r.row, r.block * cells : (r.block + 1) * cells] = np.unpackbits(np.frombuffer(r.bits, np.uint8), count=cells)
    known = docs.sparkSession.sparkContext.broadcast(np.packbits(table, axis=1))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        for b in batches:
            for portion, names in _portions(b, ["lang", "source"]):
                may = np.ones(len(portion.term), bool)
                for r, at in enumerate(portion.cells(_salts([x[0] for x in names]), width, depth)):
                    may &= (bits[r, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                group = portion.group[may]
                columns = [pa.array([x[k] for x in names], pa.string()).take(pa.array(group)) for k in (0, 1)]
                columns += [portion.words.take(pa.array(portion.term[may])).cast(pa.string()), pa.array(portion.n[may]), pa.array(portion.df[may], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "df"])

    x = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, df long")
    return x.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(n: str | Column, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), exactly; 0 where there are no terms."""
    n = F.col(n) if isinstance(n, str) else n
    x = F.lit(10**9).cast("decimal(10,0)") * (n + 5).cast("decimal(19,0)")
    y = (F.col(total) + 5 * F.col(terms)).cast("decimal(20,0)")
    whole = F.call_function("div", x, y)
    return F.when(F.col(terms) > 0, 1 + whole).otherwise(F.lit(0).cast("long"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """(lang, source, part, item, value, rank): how far sources of a language lie apart, and their telling terms.

    Part `pair` has the sum over all kept terms of the difference of the two shares, for each other source
    of the language. Most terms are in few sources: a source without a term has one share for all of them,
    so the sum is worked out from each source's own terms, and from the terms that two sources have in
    common, which a join by term finds. Part `term` has the terms whose share exceeds the language's.

    Null text, lang and source count as ''; sources without a kept term, and languages without one, take
    part; repeated rows are documents each; very long texts are split in portions; columns other than
    text, lang and source are not read, whatever their names; an empty table gives an empty result. Terms
    are counted before they are shuffled, so no frequent term or hot source meets in one task.
    """
    read = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c)
    docs = docs.select(read("lang"), read("source"), read("text"))
    every = T.written(counts(docs, least, width, depth), "divergence")
    kept = every.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("total")).filter(F.col("df") >= least)
    x = T.written(every.join(kept.select("lang", "term", "total"), ["lang", "term"]), "divergence").drop("df")
    langs = x.groupBy("lang", "term").agg(F.max("total").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("all"))
    sums = x.groupBy("lang", "source").agg(F.sum("n").alias("sum"))
    zero = F.lit(0).cast("long")
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("sum", zero).alias("sum"), F.coalesce("terms", zero).alias("terms"), F.coalesce("all", zero).alias("all"))
    groups = T.checkpointed(groups.withColumn("p0", share(zero, "sum", "terms")))
    x = T.written(x.join(groups, ["lang", "source"]).select("lang", "source", "term", share("n", "sum", "terms").alias("p"), share("total", "all", "terms").alias("q"), "p0"), "divergence")
    return _pairs(groups, x).unionByName(_terms(x, top))


def _ranked(x: DataFrame, part: str, most: int | None = None) -> DataFrame:
    """Rows by falling value, then item, numbered in each group; of many only the first `most`."""
    x = x.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return (x.filter(F.col("rank") <= most) if most else x).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _terms(x: DataFrame, top: int) -> DataFrame:
    more = x.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(more, "term", top)


def _pairs(groups: DataFrame, x: DataFrame) -> DataFrame:
    """The distances of all pairs of a language's sources, each way."""
    one = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "terms")
    two = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    pairs = T.checkpointed(one.join(two, "lang").filter("a != b"))  # as many rows as the result has
    # each source's own terms against the share that another source gives to a term it doesn't have
    own = x.groupBy("lang", F.col("source").alias("a"), "p", "p0").agg(F.count(F.lit(1)).alias("k"))
    none, no_name = F.lit(0).cast("long"), F.lit(None).cast("string")
    line = own.select("lang", "a", F.col("p").alias("at"), "k", (F.col("k") * F.col("p")).alias("s"), (F.col("k") * F.col("p0")).alias("unused"), no_name.alias("b"))
    line = line.drop("unused").unionByName(pairs.select("lang", "a", F.col("b0").alias("at"), none.alias("k"), none.alias("s"), "b"))
    up = W.partitionBy("lang", "a").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    line = line.select("lang", "a", "at", "b", F.sum("k").over(up).alias("k"), F.sum("s").over(up).alias("s")).filter("b IS NOT NULL")
    totals = x.groupBy("lang", F.col("source").alias("a")).agg(F.count(F.lit(1)).alias("ks"), F.sum("p").alias("ss"))
    line = line.join(totals, ["lang", "a"], "left")
    ks, ss = F.coalesce("ks", none), F.coalesce("ss", none)
    away = (ss - F.col("s")) - F.col("at") * (ks - F.col("k")) + F.col("at") * F.col("k") - F.col("s")
    line = line.select("lang", "a", "b", away.alias("away"), ks.alias("ks"))
    # terms of both sources: what the sums above count for them, and what they should
    left = x.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("pa0"))
    right = x.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("pb0"))
    gap = lambda u, v: F.abs(F.col(u) - F.col(v))
    both = left.join(right, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b")
    both = both.agg(F.sum(gap("pa", "pb") - gap("pa", "pb0") - gap("pa0", "pb") + gap("pa0", "pb0")).alias("more"))
    both = T.checkpointed(both)
    both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "more"))
    # each way: (a, b) has a's own terms against b0, (b, a) has b's own against a0
    back = line.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("away").alias("back"), F.col("ks").alias("back_ks"))
    y = pairs.join(line, ["lang", "a", "b"]).join(back, ["lang", "a", "b"]).join(both, ["lang", "a", "b"], "left")
    base = gap("a0", "b0")
    value = F.coalesce("more", none) + F.col("away") + F.col("back") + base * (F.col("terms") - F.col("ks") - F.col("back_ks"))
    return _ranked(y.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), value.alias("value")), "pair")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(T.documents(spark, sf_dir).select("text", "lang", "source"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS df FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::BIGINT AS total FROM c GROUP BY ALL HAVING sum(df) >= 30),
v AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS n FROM k GROUP BY lang),
f AS (SELECT lang, source, term, coalesce(c.n, 0)::BIGINT AS n, total, v.v, v.n AS all_n, coalesce(sum(c.n) OVER (PARTITION BY lang, source), 0)::BIGINT AS sum_n
  FROM (SELECT DISTINCT lang, source FROM d) JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 5) // (sum_n + 5 * v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (total + 5) // (all_n + 5 * v))::BIGINT AS q FROM f),
g AS (SELECT DISTINCT lang, source FROM d),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source AS a, y.source AS b, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y USING (lang, term) GROUP BY ALL) s ON s.lang = a.lang AND s.a = a.source AND s.b = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 50
"""
