"""Quality rules and the near-duplicate join against brute force."""

import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stemloom.llm import decontaminate, neardup, quality
from stemloom.llm import text as T


def _base(text):
    x = next(T.coded(pa.array([text], pa.string())))[1]
    assert [x.words[int(k)].as_py() for k in x.codes] == T.words_of(text)
    return quality.base_counts(text, x.codes, sum(len(x.words[int(k)].as_py()) for k in x.codes))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, (0, 0, 0, 0, 0)), ("", (0, 0, 0, 0, 0)), (" \n\t ", (0, 0, 0, 0, 0)), ("a b", (2, 2, 0, 0, 0)), ("a b c", (3, 3, 0, 0, 0)),
        ("a b c a b c", (6, 6, 0, 0, 6)), ("x x x x", (4, 4, 0, 0, 4)), ("a b c d a b c", (7, 7, 0, 0, 6)), ("#a\n\n#a\n<b>|", (3, 8, 5, 1, 0)), ("é\x85è ü", (2, 4, 0, 0, 0)),
    ],
)
def test_base_counts(text, want):
    assert _base(text) == want


def test_repeats_by_brute_force(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect():
        w = T.words_of(r.text)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        twice = {x for x, n in Counter(windows).items() if n > 1}
        marked = {k + j for k, x in enumerate(windows) if x in twice for j in range(3)}
        assert _base(r.text)[4] == len(marked)


def test_lengths_without_labels_are_judged(spark):
    rng = random.Random(4)
    plain = "the river was slow and people often walked along its green banks when evening light fell over small towns near water while children played with old boats made from paper or wood".split()
    some = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    noise = lambda n: " ".join("".join(rng.choice("qxzjvkwQXZJ") for _ in range(7)) for _ in range(n))
    rows = [(i, some(300), "en") for i in range(60)] + [(100, some(12_000), "en"), (101, noise(12_000), "en"), (102, some(60), "en"), (103, noise(60), "en"), (104, noise(300), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.judge(docs, spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")).select("row.doc_id", "base_failed", "kept").collect()}
    assert not any(got[k].base_failed for k in (101, 103, 104))
    assert not any(got[k].kept for k in (101, 103, 104))
    assert got[100].kept == (not got[100].base_failed) and got[102].kept == (not got[102].base_failed)


def test_bands_come_from_all_good_documents(spark):
    docs = spark.range(501 * quality.FIT_LEAST).select(F.col("id").alias("doc_id"), F.lit("the river was slow").alias("text"), (F.col("id") % 501).cast("string").alias("lang"))
    got = quality.fit_bands(docs, docs.select("doc_id", F.lit(1).alias("quality"))).collect()
    assert sorted(r.lang for r in got if r.lang is not None) == sorted(map(str, range(501)))
    assert len({tuple(r)[2:] for r in got}) == 1 and sum(r.lang is None for r in got) == 1


def test_each_text_is_encoded_once_and_not_written_for_the_fit(spark, monkeypatch):
    """The labels meet the measures of the texts, so what is written out, and shuffled after that, are numbers."""
    d, encoded, out = "/root/testdata/sf0.001", [], []
    measures, checkpointed = quality.measures, T.checkpointed
    monkeypatch.setattr(quality, "measures", lambda *x: encoded.append(x) or measures(*x))
    monkeypatch.setattr(T, "checkpointed", lambda x: out.append(x.schema.simpleString()) or checkpointed(x))
    assert quality.op5_quality(spark, d).count() == T.documents(spark, d).count()
    assert len(encoded) == 1 and out and not any("text:" in x for x in out)


def test_judge(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = T.documents(spark, d), T.table(spark, d, "labels")
    got = {r.doc_id: r for r in quality.judge(docs, labels).select("row.doc_id", "n_words", "n_repeat_words", "base_failed", "kept").collect()}
    assert len(got) == docs.count()
    for r in got.values():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    good = [got[r.doc_id] for r in labels.filter("quality = 1").collect()]
    bad = [got[r.doc_id] for r in labels.filter("quality = 0").collect()]
    assert sum(r.kept for r in good) >= 0.97 * sum(not r.base_failed for r in good)
    assert sum(r.kept for r in bad) <= 0.3 * len(bad)


def test_judge_odd_rows(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (2, "", "en", None), (None, "word " * 30000, "en", "y"), (3, "a b", "de", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).select("row.doc_id", "row.kept", F.col("kept").alias("verdict"), "n_words").collect()
    assert len(got) == 5 and not any(r.verdict for r in got)
    assert quality.judge(docs.limit(0), labels).count() == 0


def brute(docs):
    sets = []
    for _, t in docs:
        w = T.words_of(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links, parent = Counter(), list(range(len(docs)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (docs[i][1] or "") == (docs[j][1] or "") or a and b and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)].append(d)
    return sorted((str(d), min(least[find(i)], default=None), links[i]) for i, (d, _) in enumerate(docs))


BASE = [f"w{k % 61}x{k % 7}" for k in range(120)]


def variants():
    docs = [(0, " ".join(BASE)), (1, " ".join(BASE)), (2, None), (3, ""), (4, "   "), (5, "one two"), (6, "one two"), (7, "one  two"), (8, "one two three four five six")]
    for k in range(40):
        w = list(BASE)
        for j in range(k % 5):
            w[(17 * k + 29 * j) % 120] = f"new{k}{j}"
        docs.append((10 + k, " ".join(w)))
    docs += [(5, "one two"), (None, " ".join(BASE)), (99, "long " * 3000 + "tail"), (98, "long " * 3000 + "tail end")]
    return docs


def test_join_is_exact(spark):
    docs = variants()
    x = neardup.join(spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, root int, tid int"))
    assert sorted((str(r.doc_id), r.class_id, r.n_links) for r in x.collect()) == brute(docs)


def test_join_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 8)
    docs = variants()
    x = neardup.join(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((str(r.doc_id), r.class_id, r.n_links) for r in x.collect()) == brute(docs)


def test_join_pair_by_pair(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 8)
    monkeypatch.setattr(neardup, "SPARSE", 10**6)
    monkeypatch.setattr(T, "HUB_LEAST", 5)
    docs = variants()
    x = neardup.join(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((str(r.doc_id), r.class_id, r.n_links) for r in x.collect()) == brute(docs)


def chain(n, step):
    return [(k, " ".join(f"v{j}" for j in range(k * step, k * step + 104))) for k in range(n)]


@pytest.mark.parametrize(("step", "linked"), [(10, True), (12, False)])
def test_long_chains_take_linear_work(spark, monkeypatch, step, linked):
    """Neighbours of similarity 0.82 are linked, of 0.79 nearly; each text has two of them, and no work with the others."""
    listed = []
    real = neardup._listed
    monkeypatch.setattr(neardup, "_listed", lambda signed: listed.append(T.checkpointed(real(signed))) or listed[-1])
    n = 700
    got = {r.doc_id: r for r in neardup.join(spark.createDataFrame(chain(n, step), "doc_id long, text string")).collect()}
    assert listed and listed[0].count() < 4 * n
    assert all(r.n_links == (0 if not linked else 1 if k in (0, n - 1) else 2) for k, r in got.items())
    assert all(r.class_id == (0 if linked else k) for k, r in got.items())


def test_join_with_hot_texts(spark, monkeypatch):
    monkeypatch.setattr(T, "HUB_LEAST", 5)
    near = " ".join([*BASE[:-1], "other"])
    docs = [(k, (" ".join(BASE), near, None)[k % 3]) for k in range(60)] + variants()
    x = neardup.join(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((str(r.doc_id), r.class_id, r.n_links) for r in x.collect()) == brute(docs)


def test_join_on_corpus(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    x = neardup.join(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((str(r.doc_id), r.class_id, r.n_links) for r in x.collect()) == brute(docs)


def test_representatives(spark):
    docs = spark.createDataFrame([(d, t, "s") for d, t in variants()], "doc_id long, text string, row string")
    out = neardup.representatives(docs)
    assert out.columns == docs.columns
    classes = {r.class_id if r.class_id is not None else r.root for r in neardup.join(docs).collect()}
    assert out.count() == len(classes)
    assert neardup.representatives(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cells", [1, T.CELLS])
def test_marks_lose_no_key(spark, monkeypatch, cells):
    monkeypatch.setattr(T, "CELLS", cells)
    x = spark.range(3000).select(F.struct(F.when(F.col("id") > 0, F.col("id")).alias("k")).alias("key"))
    table = T.marks(x.filter("key.k IS NULL OR key.k % 10 = 0"), "key")
    assert table.count() <= cells
    may, none = T.marked(x, "key", table).collect(), T.marked(x, "key", table, "left_anti").collect()
    assert len(may) + len(none) == 3000 and (cells == 1 or len(may) < 400)
    assert all(r.key.k is not None and r.key.k % 10 for r in none)


@pytest.mark.parametrize("cells", [1, T.CELLS])
def test_representatives_of_repeats(spark, monkeypatch, cells):
    """Rows that no mark tells apart meet their keys all the same; a row stays once for each class."""
    monkeypatch.setattr(T, "CELLS", cells)
    monkeypatch.setattr(T, "HUB_LEAST", 5)
    docs = spark.createDataFrame([(d, t, s) for d, t in variants() * 2 for s in ("s", "t")], "doc_id long, text string, row string")
    once = spark.createDataFrame([(d, t, "s") for d, t in variants()], "doc_id long, text string, row string")
    got = [(r.doc_id, r.text) for r in neardup.representatives(docs).collect()]
    assert sorted(map(repr, got)) == sorted(repr((r.doc_id, r.text)) for r in neardup.representatives(once).collect())


def test_texts_that_stay_alone_are_not_shuffled(spark):
    """Some rows go and some texts are compared; the texts of all others, most of the bytes, stay where they are."""
    status = spark.sparkContext._jsc.sc()

    def shuffled():
        status.listenerBus().waitUntilEmpty(60_000)
        return sum(status.statusStore().executorList(False).apply(k).totalShuffleWrite() for k in range(status.statusStore().executorList(False).size()))

    rng = random.Random(5)
    rows = [(k, " ".join(f"{rng.getrandbits(64):x}" for _ in range(2000))) for k in range(200)]
    rows += [(1000 + k, f"{t} more") for k, t in rows[:10]]
    docs, bytes_of_texts = spark.createDataFrame(rows, "doc_id long, text string"), sum(len(t) for _, t in rows)
    before = shuffled()
    assert sorted(r.doc_id for r in neardup.representatives(docs).select("doc_id", F.length("text")).collect()) == list(range(200))
    assert shuffled() - before < bytes_of_texts / 2


def test_pruning_keeps_what_may_reach_the_threshold():
    table = dict(neardup.least_matches())
    assert all(0 < m < 0.8 * n for n, m in table.items())


@pytest.mark.parametrize("name", ["quality", "decontaminate"])
def test_a_batch_of_texts_is_not_held_twice(monkeypatch, name):
    """A worker codes some rows of a batch at a time; what it returns is that of all rows."""
    made, rows, coded = [], [], T.coded
    monkeypatch.setattr(quality.F, "pandas_udf", lambda _: lambda f: made.append(f) or SimpleNamespace(asNondeterministic=lambda: lambda _: None))
    monkeypatch.setattr(T, "coded", lambda x: rows.append(len(x)) or coded(x))
    item = " ".join(f"exam{k}" for k in range(20))
    texts = pd.Series([None, "", *(f"some words {'#' * (k % 3)} {item if k % 500 == 0 else k}" for k in range(3000))])
    if name == "quality":
        quality.measures(None)
        got = next(made[0](iter([texts])))
        assert got.n_words.tolist() == [len(T.words_of(x)) for x in texts] and got.n_symbols.tolist() == [(x or "").count("#") for x in texts]
    else:
        tokens, _ = next(coded(pa.array([item])))[1].values(decontaminate._memo(), "<u8")
        decontaminate._finder(SimpleNamespace(value=decontaminate.Seeds([tokens])))
        got = next(made[0](iter([texts])))
        assert [k for k, x in enumerate(got) if x] == [k for k, x in enumerate(texts) if item in (x or "")]
    assert len(got) == len(texts) == sum(rows) and max(rows) <= 1024


def test_sets_come_in_portions():
    """The sets of a batch of long texts are as large as the texts; they leave it in portions, none lost."""
    rng = random.Random(6)
    texts = [None, "", *(" ".join(f"{rng.getrandbits(32):x}" for _ in range(20_000)) for _ in range(30))]
    out = list(neardup._sets([pa.record_batch({"tid": list(range(len(texts))), "text": texts, "copies": [1] * len(texts)})]))
    assert max(x.nbytes for x in out) < sum(x.nbytes for x in out) / 4
    assert [k for x in out for k in x.column("tid").to_pylist()] == list(range(len(texts)))
    want = [s.tobytes() for _, some in neardup.text_shingles(pa.array(texts, pa.string())) for s in some]
    assert [s for x in out for s in x.column("set").to_pylist()] == want and len(np.frombuffer(want[2], np.uint64)) == 19_996
