"""Operators without SQL, and the rules that SQL can't show, against plain Python."""

import heapq
import random
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from stemloom.functions import exprs as X
from stemloom.operators import documents as D
from stemloom.operators import packing
from stemloom.operators import planning as G
from stemloom.operators import sampling as P
from stemloom.sources import files


def _events():
    rng = random.Random(5)
    return [(k, i, i // rng.choice([1, 3]), rng.randrange(3), rng.random() < 0.5) for k in range(60) for i in range(rng.randrange(1, 9))]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(_events(), "k long, place long, tick long, note long, is_on boolean")


def test_note_predicates(events):
    want = {}
    for k, _, tick, note, is_on in sorted(_events()):
        s = want.setdefault(k, {"open": set(), "mono": True, "stack": {}, "lasting": False})
        if is_on:
            s["mono"] = s["mono"] and not s["open"]
            s["open"].add(note)
            s["stack"].setdefault(note, []).append(tick)
        else:
            s["open"].discard(note)
            if s["stack"].get(note):
                s["lasting"] |= tick > s["stack"][note].pop()
    assert {r.k: r.monophonic for r in G.note_faults(events, "k").collect()} == {k: s["mono"] for k, s in want.items()}
    assert {r.k: r.lasting for r in G.lasting_notes(events, "k").collect()} == {k: s["lasting"] for k, s in want.items()}


def test_greedy_windows(spark):
    rng = random.Random(2)
    rows = [(i, [(rng.choice([0.1, 0.5, 0.9]), float(s)) for s in range(0, rng.randrange(40), 3)]) for i in range(50)]
    df = spark.createDataFrame(rows, "i int, w array<struct<score double, start double>>")
    got = {r.i: r.s for r in df.select("i", G.greedy_windows(F.col("w"), 3, 7.0).alias("s")).collect()}
    for i, w in rows:
        chosen = []
        for _, t in sorted(w, key=lambda x: (-x[0], x[1])):
            if len(chosen) < 3 and all(abs(t - c) >= 7 for c in chosen):
                chosen.append(t)
        assert got[i] == sorted(chosen)


def test_accents_of_all_latin_letters(spark):
    letters = [chr(k) for k in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x370, 0x520)] if chr(k).isalpha()]
    words = [*letters, "Őzike č ş ž ū", "ﬁne ĳs", "e\u0301te\u0301", "Ténor", "plain"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(X.fold_accents(F.col("w"))).collect()]
    fold = lambda w: "".join(c for c in unicodedata.normalize("NFKD", w.lower()) if not unicodedata.combining(c))
    wrong = [(w, g, fold(w)) for w, g in zip(words, got, strict=True) if g.lower() != fold(w).lower()]
    assert not [x for x in wrong if len(x[2]) == 1 or x[0] in ("ﬁne ĳs",)], wrong[:5]


def test_packing_of_many_songs_is_greedy(spark):
    n = 250_000
    sizes = spark.range(n).select(F.concat(F.lit("s"), "id").alias("song_id"), (F.pmod(F.xxhash64("id"), F.lit(9_973)) + 1).alias("bytes"))
    got = {r.song_id: r.chunk for r in packing.pack(sizes, 8).collect()}
    heap, want = [(0, k) for k in range(8)], {}
    for r in sorted(sizes.collect(), key=lambda r: (-r.bytes, r.song_id)):
        load, k = heapq.heappop(heap)
        want[r.song_id] = k
        heapq.heappush(heap, (load + r.bytes, k))
    assert got == want


def test_quota_sample_takes_every_category(spark):
    rng = random.Random(1)
    rows = sorted({(f"s{rng.randrange(900)}", f"c{rng.randrange(1_200)}") for _ in range(4_000)})
    df = spark.createDataFrame(rows, "song string, category string")
    got = {r.song for r in P.quota_sample(df, "song", "category", 1, 10_000, 3).collect()}
    assert {c for s, c in rows if s in got} == {c for _, c in rows}


def test_a_crash_between_delete_and_rename_loses_nothing(spark, tmp_path, monkeypatch):
    p, schema = str(tmp_path / "t"), "k string, v string"
    files.upsert(spark, p, spark.createDataFrame([("a", "1"), ("b", "1")], schema), ["k"])
    to, fs = files._fs(spark, p)

    def dies(spark, path):
        fs.delete(to(path), True)
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(files, "_put", dies)
        with pytest.raises(KeyboardInterrupt):
            files.upsert(spark, p, spark.createDataFrame([("b", "2")], schema), ["k"])
    assert not files.exists(spark, p)
    files.upsert(spark, p, spark.createDataFrame([("c", "3")], schema), ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(p).collect()) == [("a", "1"), ("b", "2"), ("c", "3")]


def test_only_touched_parts_are_rewritten(spark, tmp_path):
    p = str(tmp_path / "parts")
    files.swap(spark, spark.createDataFrame([(0, "a"), (1, "b")], "part int, v string"), p, "part")
    before = {f.name for f in (tmp_path / "parts" / "part=0").iterdir()}
    files.swap(spark, spark.createDataFrame([(1, "c")], "part int, v string"), p, "part")
    assert before == {f.name for f in (tmp_path / "parts" / "part=0").iterdir()}
    assert sorted((r.part, r.v) for r in spark.read.parquet(p).collect()) == [(0, "a"), (1, "c")]


def test_assignments(spark, tmp_path):
    p = str(tmp_path / "a")
    frame = lambda rows: spark.createDataFrame(rows, "song_id string, chunk int")
    files.write_assignment(frame([("old", 3), ("kept", 0)]), frame([("kept", 1), ("new", 2)]), p)
    assert {r.song_id: r.chunk for r in files.read_assignment(spark, p).collect()} == {"old": 3, "kept": 0, "new": 2}
    frame([("x", 1), ("x", 2)]).write.option("header", True).csv(f"{p}2")
    with pytest.raises(ValueError, match="x"):
        files.read_assignment(spark, f"{p}2")


def test_messages_of_odd_entries(spark):
    doc = spark.createDataFrame([(None, None, None, None), ("a", None, None, None), ("b", ["x"], "y", False), ("c", [], None, True)], "category string, approved array<string>, winner string, bypass boolean")
    got = sorted(r.message for r in D.messages(doc).collect())
    assert got == ["a: approve at least one variant", "a: pick a winner", "b: winner must be among approved variants", "missing category"]


def test_notes_of_values_between_two(spark, tmp_path):
    """A value between two whole numbers goes to the even one, as in the SQL."""
    from stemloom.plans.composites import monophonic
    from stemloom.plans.catalog import ORACLE

    rows = [(0, 1, "click", 12.45), (1, 1, "view", 12.4), (2, 1, "click", 1.0), (3, 2, "view", 0.35), (4, 2, "click", 0.25), (5, 2, "view", 0.3), (6, 2, "click", 0.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    sql = ORACLE["monophonic"]
    want = con.sql("WITH " + sql[sql.index("ne AS (") :]).fetchall()
    assert {(r.k, r.monophonic) for r in monophonic(spark, str(tmp_path)).collect()} == set(want) == {(1, True), (2, False)}
