"""Periodic runs against plain loops over all periods and places."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from stemloom.llm import periodic
from stemloom.llm import text as T

ODD = [
    (1, "a a a a a a"), (2, None), (3, ""), (4, " \t\n "), (5, "a a a a a"), (6, "x a b a b a b a b y"), (7, "a b c " * 9 + "a b"), (7, "a b c " * 9 + "a b"),
    (None, "é é é é é é 東 東\x85a"), (8, "a b " * 5 + "b a " * 6), (9, "a a b " * 8 + "a a a a a a a"), (10, "w " * 3000), (11, "solo"), (12, "a a a a b a a a a b a a a a b a a a a b a a"),
]


def plain(words, least=6, copies=4):
    """All runs, by the longest stretches of equal words for each distance; smallest period of each stretch."""
    n, best = len(words), {}
    for q in range(1, n // copies + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, copies * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def kept(words, runs):
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def rewritten(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def want(doc_id, text):
    words = rewritten(doc_id, T.words_of(text))
    runs = plain(words)
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, digest("".join(f"{s},{size},{q}\n" for s, size, q in runs)), digest(kept(words, runs)))


def key(rows):
    return sorted(tuple(map(str, r)) for r in rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in ODD], "doc_id long, text string, runs int, Row string")
    got = periodic.collapse(docs).select("row.doc_id", "row.Row", "runs", "text").collect()
    assert all(r.Row == "x" for r in got)
    assert key((r.doc_id, [tuple(x) for x in r.runs], r.text) for r in got) == key((i, plain(T.words_of(t)), kept(T.words_of(t), plain(T.words_of(t)))) for i, t in ODD)
    assert periodic.collapse(docs.limit(0)).count() == 0


def test_query(spark, tmp_path):
    rng = random.Random(5)
    rows = ODD + [(i, " ".join(rng.choice("abcdefgh"[: 1 + i % 8]) for _ in range(rng.randrange(120)))) for i in range(100, 400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert key(periodic.op13_periodic(spark, str(tmp_path)).collect()) == key(want(*r) for r in rows)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id for r in rows if len(r.text) < 8_000}  # the loops are quadratic
    got = [r for r in periodic.op13_periodic(spark, sf).collect()]
    assert len(got) == len(rows) and sum(r.n_runs > 0 for r in got) >= 5
    assert key(r for r in got if r.doc_id in short) == key(want(*r) for r in rows if r.doc_id in short)


def found(codes, **more):
    codes = np.array(codes, np.int64)
    k = periodic.overlap()
    runs = periodic.runs_of(codes, *periodic.segments(codes, np.array([0, len(codes)]), k), **more)
    return sorted((int(s), int(e - s), int(p)) for s, e, p in runs)


def test_random_words_with_few_letters():
    rng = random.Random(1)
    for n in [*range(30), 57, 100, 233]:
        for letters in (1, 2, 3):
            for _ in range(6):
                codes = [rng.randrange(letters) for _ in range(n)]
                assert found(codes) == plain(codes)
                root = [rng.randrange(letters) for _ in range(1 + rng.randrange(9))]
                planted = codes + root * rng.randrange(3, 12) + root[: rng.randrange(len(root))] + codes[::-1]
                assert found(planted) == plain(planted)


def test_equal_hashes_of_different_words_lose_no_run(monkeypatch):
    """With all words hashed alike, each run comes from the comparison of words."""
    rng = random.Random(2)
    real = periodic._Prefixes.equal
    codes = [rng.randrange(3) for _ in range(40)] + [0, 1, 2] * 9 + [1, 1, 0, 2] * 6
    monkeypatch.setattr(periodic._Prefixes, "equal", lambda self, i, p, size: real(self, i, p, size) | (size % 5 == 3))
    assert set(plain(codes)) <= set(found(codes))


def test_pairs_in_pieces(monkeypatch):
    codes = [0, 1] * 300 + [2] * 100
    monkeypatch.setattr(periodic, "PAIRS", 7)
    assert found(codes) == plain(codes)


def test_overlap_of_the_shortest_runs():
    assert periodic.overlap() == 5 and periodic.overlap(2, 2) == 1 and periodic.overlap(10, 3) == 7


@pytest.mark.parametrize("q", [1, 2, 5, 1000])
def test_long_texts(q):
    codes = np.tile(np.arange(q), 500_000 // q)
    began = time.time()
    assert found(codes) == [(0, len(codes), q)]
    assert time.time() - began < 20
