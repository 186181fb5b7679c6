"""Mixing and sharding on awkward rows."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemloom.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string, size string, copies int, row int"
ROWS = [(i, "w " * (1 + i % 7), f"s{i % 3}", "x", 9, 1) for i in range(60)]
ROWS += [(100 + i, "same words here", "hot", "x", 9, 1) for i in range(80)]
ROWS += [(7, None, None, None, None, None), (None, "", None, "y", 1, 1), (8, "w " * 5000, "s1", "z", 1, 1), (8, "w " * 5000, "s1", "z", 1, 1), (9, "\x85 \x0b a", "s2", "", 0, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def words(t):
    return len([w for w in (t or "").translate({c: " " for c in range(9, 14)}).split(" ") if w])


def fill(sizes):
    """Targets by resharing the excess until none is above: plain loops."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            target.update({s: left * weight[s] / total for s in free})
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    return target


def test_mix(docs):
    got = mixing.decide(docs).select("row.doc_id", "row.source", F.col("row.text").alias("t"), "size", "source_size", "target", "copies", "taken").collect()
    assert len(got) == len(ROWS)
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in got:
        assert r.size == words(r.t) and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    target = fill(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * most[s] + 1
    again = mixing.decide(docs).select("row.doc_id", "copies").collect()
    assert Counter((r.doc_id, r.copies) for r in again) == Counter((r.doc_id, r.copies) for r in got)


def test_mixed_documents_keep_their_columns(docs):
    out = mixing.mix(docs)
    assert out.schema == docs.schema
    want = mixing.decide(docs).agg(F.sum("copies")).first()[0]
    assert out.count() == want


def test_mix_of_nothing(spark):
    assert mixing.decide(spark.createDataFrame([], SCHEMA)).count() == 0


def test_oracle(spark):
    from tests.oracle import assert_same, duck

    d = "/root/testdata/sf0.001"
    assert_same(mixing.op1_mixing(spark, d), duck(d), mixing.ORACLE_SQL)


def test_hypergeometric(spark):
    g, b, k = 30, 70, 20
    u = F.shiftrightunsigned(F.xxhash64("id"), 11).cast("double") / float(1 << 53)
    got = [r[0] for r in spark.range(4000).select(sharding.hypergeometric(F.lit(g), F.lit(b), F.lit(k), u)).collect()]
    n = g + b
    mean, var = k * g / n, k * g * b * (n - k) / n**2 / (n - 1)
    assert min(got) >= 0 and max(got) <= k
    assert abs(np.mean(got) - mean) < 4 * (var / 4000) ** 0.5 and abs(np.var(got) / var - 1) < 0.12


@pytest.mark.parametrize(("good", "bad", "draws", "want"), [(0, 5, 3, 0), (5, 0, 3, 3), (4, 6, 0, 0), (4, 6, 10, 4), (0, 0, 0, 0)])
def test_hypergeometric_edges(spark, good, bad, draws, want):
    assert spark.range(1).select(sharding.hypergeometric(F.lit(good), F.lit(bad), F.lit(draws), F.lit(0.7))).first()[0] == want


def test_shards(docs):
    got = sharding.shard(docs, [F.col("doc_id"), F.xxhash64("text")], shards=7, blocks=8).select("row.doc_id", "shard", "slot").collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 7
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r.shard for r in got if r.doc_id and r.doc_id >= 100}) == 7


def test_copies_of_one_row_spread(spark):
    x = spark.range(4000).select(F.lit(1).alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.shard(x, [F.col("doc_id"), F.xxhash64("text")], shards=4, blocks=8).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [1000] * 4


def test_shards_of_nothing(spark):
    assert sharding.shard(spark.createDataFrame([], SCHEMA), [F.col("doc_id")], 7, 8).count() == 0


def test_shard_query(spark):
    d = "/root/testdata/sf0.001"
    got = sharding.op4_sharding(spark, d).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        b = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(b) + 16, zlib.crc32(b), "rows", None)
