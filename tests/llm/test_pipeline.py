"""The corpus pipeline: each stage against plain Python, odd rows, and the whole run."""

import itertools
import random
import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, shard int, row string"
WORDS = [f"word{k}" for k in range(400)]
ITEM = " ".join(f"exam{k}" for k in range(20))


def _text(rng, n=80):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _rows():
    rng = random.Random(3)
    rows = [(i, _text(rng), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), i, "r") for i in range(120)]
    near = rows[0][1].split()
    near[40] = "changed"
    rows += [(200, rows[0][1], "en", "a", 1, "r"), (201, " ".join(near), "en", "a", 2, "r"), (202, rows[5][1] + " " + ITEM, "en", "b", 3, "r")]
    rows += [(203, None, None, None, None, None), (204, "", "en", "a", 4, "r"), (205, "too short", "en", "a", 5, "r"), (None, _text(rng), "en", "a", 6, "r"), (206, "again and " * 60, "de", "b", 7, "r")]
    return rows + [(7, rows[7][1], "en", "a", 8, "r"), rows[8], rows[8]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(_rows(), SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def _plain(rows):
    return [tuple(r) for r in rows]


def _key(rows):
    return sorted(map(repr, rows))


def _shingles(text):
    w = (text or "").split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_quality_drops_what_fails_the_base_rule(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = _plain(pipeline.quality_rules(spark, docs, folder).collect())
    rows = _rows()
    assert not {203, 204, 205, 206} & {r[0] for r in kept}
    assert not Counter(map(repr, kept)) - Counter(map(repr, rows))
    good = [r for r in rows if r[0] is not None and r[0] < 120 and r[0] % 2 == 0]
    assert sum(Counter(map(repr, kept))[x] for x in set(map(repr, good))) >= 0.97 * len(good)


def test_quality_of_a_part_is_that_of_the_whole(spark, folder, monkeypatch):
    """The bands come from the whole table, of which only numbers are written out."""
    out, checkpointed = [], pipeline.T.checkpointed
    monkeypatch.setattr(pipeline.T, "checkpointed", lambda x: out.append(x.schema.simpleString()) or checkpointed(x))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    whole = _plain(pipeline.quality_rules(spark, docs, folder).collect())
    part = _plain(pipeline.quality_rules(spark, docs.filter("doc_id % 3 = 1"), folder).collect())
    assert part and _key(part) == _key(r for r in whole if r[0] is not None and r[0] % 3 == 1)
    assert out and not any("text:" in x for x in out)


def test_one_of_each_class_stays(spark, folder):
    rows = _rows()
    got = _plain(pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), folder).collect())
    texts = sorted({r[1] or "" for r in rows})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in itertools.combinations(texts, 2):
        x, y = _shingles(a), _shingles(b)
        if x and y and len(x & y) >= 0.8 * len(x | y):
            root[find(a)] = find(b)
    classes = {}
    for r in rows:
        classes.setdefault(find(r[1] or ""), []).append(r)
    least = lambda c: min((r[0] for r in c if r[0] is not None), default=None)
    assert sorted(repr(r[0]) for r in got) == sorted(repr(least(c)) for c in classes.values())
    assert all(r in classes[find(r[1] or "")] for r in got)


def test_documents_with_a_test_item_go(spark, folder):
    rows = _rows()
    got = _plain(pipeline.decontamination(spark, spark.createDataFrame(rows, SCHEMA), folder).collect())
    assert _key(got) == _key(r for r in rows if ITEM not in (r[1] or ""))


def test_the_mix_has_whole_documents_near_the_targets(spark, folder):
    rows = _rows()
    got = _plain(pipeline.source_mixing(spark, spark.createDataFrame(rows, SCHEMA), folder).collect())
    assert set(map(repr, got)) <= set(map(repr, rows))
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    own, taken = Counter(), Counter()
    for r in rows:
        own[r[3]] += size(r)
    for r in got:
        taken[r[3]] += size(r)
    order, left, total = sorted(own, key=lambda s: (s is None, s or "")), dict.fromkeys(own), sum(own.values())
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, left = {}, set(own)
    while left:
        free = total - sum(target.values())
        share = {s: free * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * own[s]}
        target |= {s: 3.0 * own[s] for s in over} if over else share
        left = left - over if over else set()
    assert all(abs(taken[s] - target[s]) <= 2 * max(size(r) for r in rows) for s in own)


def test_shards_hold_every_row_once(spark, folder):
    rows = _rows() * 3
    got = pipeline.uniform_sharding(spark, spark.createDataFrame(rows, SCHEMA), folder)
    assert got.columns == ["doc_id", "text", "lang", "source", "shard", "row", "shard_", "slot"]
    got = _plain(got.collect())
    assert _key(r[:6] for r in got) == _key(rows)
    slots = {}
    for r in got:
        slots.setdefault(r[6], []).append(r[7])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(40)]
    assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES])
def test_no_rows(spark, folder, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), folder).count() == 0


def test_run_is_its_stages(spark, folder):
    got = pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in got}
    assert not {200, 201, 202, 203, 204, 205, 206} & ids
    assert len({r.doc_id for r in got}) > 60
    assert max(Counter((r.shard_, r.slot) for r in got).values()) == 1
